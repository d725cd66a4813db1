"""Duplicates hidden by formatting differences (problem 4).

Everything up to the 128-bit hash is one projection; the text itself is never shuffled. It stays in
the JVM but for texts with literals that stand in others or hold brackets with commas, which are read
by a stack in Arrow batches. Counts are combined on the map side, so a text that makes up a third of
all rows sends one row per task.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize

NOT_ALNUM = r"[^\p{L}\p{N}]+"
#: A literal with named fields all of whose commas part fields: brackets in it hold neither commas nor brackets.
LITERAL = r"\(\s*\{(?:[^(){}\[\]]|\([^(){}\[\],]*\)|\[[^(){}\[\],]*\])*\}\s*\)"
#: The begin of a literal.
OPENING = r"\(\s*\{"

_SIGNS = re.compile(r"(\(\s*\{)|(\}\s*\))|([()\[\]{},])")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


def letters_and_digits(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, NOT_ALNUM, ""))


def words_text(text: Column) -> Column:
    """The words of a text (longest runs of letters or digits, lower case) joined by one blank."""
    return F.trim(F.lower(F.regexp_replace(text, NOT_ALNUM, " ")))


def sorted_fields(text: str) -> str:
    """``text`` with the fields of each literal ``({ ... })`` in order, by their letters and digits.

    A comma parts fields only where no bracket within the literal is open; literals may stand in
    literals. A literal that is never closed is none. What else stands in the text is kept but for
    brackets and commas within literals.
    """
    # a frame is an open bracket: its kind, the fields done, and the parts of the field at hand
    stack: list[tuple[str, list[str], list[str]]] = [("", [], [])]
    last = 0

    def close(kind: str) -> None:
        if stack[-1][0] == kind:
            _, fields, parts = stack.pop()
            if kind == "L":
                own = ["".join(c for c in "".join(x) if c.isalnum()).lower() for x in (*fields, parts)]
                stack[-1][2].append("".join(sorted(own)))
            else:
                stack[-1][2].extend(parts)

    for m in _SIGNS.finditer(text):
        stack[-1][2].append(text[last : m.start()])
        last = m.end()
        sign = m.group()
        if m.group(1):
            stack.append(("L", [], []))
        elif m.group(2):
            if stack[-1][0] == "L":
                close("L")
            else:
                close("}")
                close(")")
        elif sign in _PAIRS:
            stack.append((_PAIRS[sign], [], []))
        elif sign == ",":
            if stack[-1][0] == "L":
                stack[-1][1].append(stack[-1][2].copy())
                stack[-1][2].clear()
        else:
            close(sign)
    stack[-1][2].append(text[last:])
    while len(stack) > 1:  # never closed: their parts in the order of the text
        _, fields, parts = stack.pop()
        stack[-1][2].extend(x for f in fields for x in f)
        stack[-1][2].extend(parts)
    return "".join(stack[0][2])


def canonical_text(text: Column, words: Column | None = None) -> Column:
    """Letters and digits in order, lower case, the fields of each ``({ ... })`` sorted (``sorted_fields``).

    ``words``, if given, is the text's ``words_text``, from which a text without literals is read."""
    between = F.split(text, LITERAL)
    literals = F.regexp_extract_all(text, F.lit(LITERAL), F.lit(0))

    def one(outside: Column, i: Column) -> Column:
        fields = F.array_sort(F.transform(F.split(F.get(literals, i), ","), letters_and_digits))
        return F.concat(letters_and_digits(outside), F.coalesce(F.array_join(fields, ""), F.lit("")))

    @F.pandas_udf("string")
    def stacked(texts: pd.Series) -> pd.Series:
        return texts.map(sorted_fields, na_action="ignore")

    sorted_form = F.array_join(F.transform(between, one), "")
    # a plain literal has one opening, so there are more of them where a literal needs the stack
    opened = F.regexp_count(text, F.lit(OPENING))
    harder = opened > F.size(literals)
    by_stack = letters_and_digits(stacked(F.when(text.contains("{") & harder, text)))
    plain = letters_and_digits(text) if words is None else F.replace(words, F.lit(" "), F.lit(""))
    return F.when(~text.contains("{") | (opened == 0), plain).when(harder, by_stack).otherwise(sorted_form)


def copy_key(text: Column) -> Column:
    """128-bit hash of the canonical text; null where the text is null or holds only blanks.

    A text of punctuation alone has an empty canonical form and is a copy of others like it.
    """
    blank = text.isNull() | ~text.rlike(r"[^\s\p{Z}]")
    canonical = canonical_text(text)
    return F.when(blank, None).otherwise(
        F.struct(
            F.md5(canonical.cast("binary")).alias("h"), F.xxhash64(canonical).alias("check"),
            F.length(canonical).alias("n"),
        )
    )


def copy_signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, h, check, n`` of every row that has a text, written to the shared folder."""
    keyed = df.select(F.col(id_col).alias("id"), copy_key(F.col(text_col)).alias("k"))
    keyed = keyed.where("k is not null").select(
        "id", F.unhex("k.h").alias("h"), "k.check", "k.n"
    )
    return materialize(keyed, "copies")


def collapse_copies(signatures: DataFrame) -> DataFrame:
    """``h, check, n, kept_id, n_copies``, one row per distinct text: the least id is kept.

    The second hash and the length take part in the key, so texts whose 128 bits clash stay
    apart; ``hash_clashes`` counts those.
    """
    return signatures.groupBy("h", "check", "n").agg(
        F.min("id").alias("kept_id"), F.count("id").alias("n_copies")
    )


def hash_clashes(signatures: DataFrame) -> DataFrame:
    """One row ``n_hashes, n_clashes``: 128-bit values, and those that two texts share."""
    return (
        signatures.groupBy("h")
        .agg(F.min(F.struct("check", "n")).alias("lo"), F.max(F.struct("check", "n")).alias("hi"))
        .agg(F.count("h").alias("n_hashes"), F.coalesce(F.count_if(F.expr("lo <> hi")), F.lit(0)).alias("n_clashes"))
    )


def copy_pairs(signatures: DataFrame) -> DataFrame:
    """``kept_id, example_id``: the least id of each set of copies with each of the others.

    Only sets of two or more are joined back. Both sides are written tables, so that the
    adaptive skew join can split a set that holds a large part of all rows.
    """
    sets = materialize(
        collapse_copies(signatures).where("n_copies > 1").select("h", "check", "n", "kept_id"), "sets"
    )
    return (
        signatures.join(sets, ["h", "check", "n"])
        .where("id <> kept_id")
        .select("kept_id", F.col("id").alias("example_id"))
    )
