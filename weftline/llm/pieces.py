"""Splitting oversized texts at natural boundaries (problem 1).

One bounded-quantifier regular expression, evaluated in the JVM, consumes a text piece by piece:
its alternatives are ordered by the strength of the boundary they end at, and the last one takes
any characters. Overlap is a look back into the piece before, by SQL array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def boundary_pattern(size: int) -> str:
    """Alternatives that take at most ``size`` code points, strongest boundary first.

    Ends of blocks, statements and lines are first sought where a piece is at least half full,
    then anywhere; blanks and single characters are the fallback.
    """
    half, low = max(1, size // 2), max(1, size // 4)
    line = r"(?:(?<=\n)|(?<=\r)(?!\n))"
    block, statement = r"(?<=\})" + r"(?=\s|\z)\s{0,2}?" + line, r"(?<=[;{}])" + r"\s{0,2}?" + line
    inline, blank = r"(?<=[;{}])", r"(?<=\s)"
    parts = [rf".{{1,{size}}}\z"]
    for end in (block, statement, line, inline):
        parts.append(rf".{{{half},{size - 2}}}{end}")
    for end in (statement, line, inline):
        parts.append(rf".{{{low},{size - 2}}}{end}")
    for end in (line, inline, blank):
        parts.append(rf".{{1,{size - 2}}}{end}")
    parts.append(rf".{{1,{size}}}")
    return "(?s)(?:" + "|".join(parts) + ")"


def pieces_of(text: Column, limit: int = 1200, overlap: int = 120) -> Column:
    """``ARRAY<STRUCT<overlap INT, piece STRING>>`` of a text column; null stays null.

    A text of at most ``limit`` code points is one piece, an empty one one empty piece. Every
    piece of a longer text has at most ``limit`` code points, of which the first ``overlap`` or
    fewer repeat the end of the piece before, from a line start where the first half of its tail holds
    one. At least half of ``overlap`` is repeated, or all of the piece before where that has less.
    ``substring(piece, overlap + 1)`` of all pieces in order gives the text again.
    """
    if not 0 <= overlap < limit - 8:
        raise ValueError("overlap must be smaller than the limit by more than 8")
    bodies = F.regexp_extract_all(text, F.lit(boundary_pattern(limit - overlap)), F.lit(0))

    def with_lookback(parts: Column) -> Column:
        def one(body: Column, i: Column) -> Column:
            tail = F.when(i == 0, F.lit("")).otherwise(F.right(F.get(parts, i - 1), F.lit(overlap)))
            # a tail is only cut at its begin if it has the whole length
            begin = rf"(?s)\A[^\n]{{0,{overlap - overlap // 2 - 1}}}\n(?=.{{{max(overlap // 2, 1)}}})"
            tail = F.regexp_replace(tail, begin, "") if overlap else F.lit("")
            return F.struct(F.length(tail).alias("overlap"), F.concat(tail, body).alias("piece"))

        return F.transform(parts, one)

    whole = F.array(F.struct(F.lit(0).alias("overlap"), text.alias("piece")))
    return F.when(text.isNull(), None).when(F.length(text) <= limit, whole).otherwise(with_lookback(bodies))


def split_oversized(
    df: DataFrame, id_col: str, text_col: str, limit: int = 1200, overlap: int = 120
) -> DataFrame:
    """``<id_col>, piece_no, n_pieces, overlap, piece`` for every row, pieces numbered from 0.

    A null text comes out as one row with a null piece, ``n_pieces`` 0; repeated rows come out
    as often as they are. Other columns of ``df`` are not looked at. No shuffle takes place.
    """
    cut = df.select(F.col(id_col), pieces_of(F.col(text_col), limit, overlap).alias("__pieces"))
    return cut.select(
        F.col(id_col), F.posexplode_outer("__pieces").alias("piece_no", "__p"),
        F.coalesce(F.size("__pieces"), F.lit(0)).alias("n_pieces"),
    ).select(
        id_col, F.coalesce("piece_no", F.lit(0)).alias("piece_no"),
        F.greatest("n_pieces", F.lit(0)).alias("n_pieces"),
        F.coalesce("__p.overlap", F.lit(0)).alias("overlap"), F.col("__p.piece").alias("piece"),
    )


def rebuilt(pieces: DataFrame, id_col: str, text: str, limit: int) -> DataFrame:
    """``<id_col>, <text>, over``: the texts again from the pieces of ``split_oversized`` of unique ids, null for
    a null text, and the number of each one's pieces of more than ``limit`` code points."""
    body = F.col("piece").substr(F.col("overlap") + 1, F.length("piece"))
    parts = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("piece_no", body.alias("body")))))
    return pieces.groupBy(id_col).agg(parts.alias("__p"), F.count_if(F.length("piece") > limit).alias("over")).select(
        id_col, F.when(F.size("__p") > 0, F.array_join(F.transform("__p", lambda x: x["body"]), "")).alias(text), "over"
    )
