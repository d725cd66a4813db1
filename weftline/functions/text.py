"""Text scalars as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_source(src: Column) -> Column:
    """without block comments, line comments and white space, in lower case. Null stays null.

    ``(?d)`` ends a line comment at a line feed only; ``(?U)`` takes all Unicode white space.
    """
    out = F.regexp_replace(src, r"(?s)/\*.*?\*/", "")
    out = F.regexp_replace(out, r"(?d)//.*", "")
    return F.lower(F.regexp_replace(out, r"(?U)\s+", ""))


def source_hash(src: Column) -> Column:
    """SHA-256 of the normalised source, in hex."""
    return F.sha2(normalize_source(src), 256)


def clean_comments(src: Column) -> Column:
    """Line comments, then block comments removed; blanks of each line collapsed, empty lines dropped."""
    out = F.regexp_replace(F.regexp_replace(src, r"(?d)//.*", ""), r"(?s)/\*.*?\*/", "")
    lines = F.transform(F.split(out, r"\r\n|[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def swap_literals(src: Column) -> Column:
    """0x0 with address(0) and uint with uint256, each in the direction that applies."""
    out = F.when(src.rlike(r"\b0x0\b"), F.regexp_replace(src, r"\b0x0\b", "address(0)")).otherwise(
        F.replace(src, F.lit("address(0)"), F.lit("0x0"))
    )
    return F.when(out.rlike(r"\buint\b"), F.regexp_replace(out, r"\buint\b", "uint256")).otherwise(
        F.regexp_replace(out, r"\buint256\b", "uint")
    )


def line_of(src: Column, offset: Column) -> Column:
    """The number, from 1, of the line in which a character stands."""
    return F.length(F.regexp_replace(F.substring(src, F.lit(1), offset), r"[^\n]", "")) + 1


def basename(path: Column) -> Column:
    """what follows the last slash."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*\z", "")


def strip_brackets(type_name: Column) -> Column:
    """trailing square brackets in any number."""
    return F.regexp_replace(type_name, r"[\[\]]+\z", "")


def typed_name(type_name: Column, name: Column) -> Column:
    """F8: type and name joined by one blank, either of which may be missing."""
    return F.trim(F.concat(F.coalesce(type_name, F.lit("")), F.lit(" "), F.coalesce(name, F.lit(""))))


def word_count(text: Column) -> Column:
    """tokens by the offline stand-in, runs of word characters and single other signs."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"))


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    """part of whole in percent; 0 where the whole is 0."""
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), places)


def parse_location(loc: Column) -> Column:
    """``file::function#L10-L20`` as a struct; function and lines may be missing."""
    head = F.substring_index(loc, "#", 1)
    has_function = head.contains("::")
    lines = F.when(loc.contains("#"), F.trim(F.regexp_extract(loc, r"#(.*)\z", 1)))
    return F.struct(
        F.trim(F.substring_index(head, "::", 1)).alias("file"),
        F.when(has_function, F.trim(F.regexp_extract(head, r"::(.*)\z", 1))).alias("function"),
        lines.alias("lines"),
    )


def parse_line_range(text: Column) -> Column:
    """``L175-216``, ``L70 - L105`` or ``L78`` as a struct of start and stop; (0, 999999) for none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[Ll\s]", "")
    first = F.regexp_extract(bare, r"\A(\d+)(?:-|\z)", 1).try_cast("int")
    last = F.regexp_extract(bare, r"\A\d+-(\d+)(?:-|\z)", 1).try_cast("int")
    ok = first.isNotNull() & (last.isNotNull() | ~bare.contains("-"))
    return F.struct(
        F.when(ok, first).otherwise(0).alias("start"),
        F.when(ok, F.coalesce(last, first)).otherwise(999999).alias("stop"),
    )


def code_of(category: Column) -> Column:
    """The first two parts of ``SWC-107-Reentrancy``, or all of it."""
    return F.substring_index(category, "-", 2)


def elided(src: Column, most: int, head: int, tail: int, marker: str = "...") -> Column:
    """A source of more than ``most`` lines as its first and last lines around a marker."""
    lines = F.split(src, "\n")
    short = F.concat(F.slice(lines, 1, head), F.array(F.lit(marker)), F.slice(lines, -tail, tail))
    return F.when(F.size(lines) > most, F.array_join(short, "\n")).otherwise(src)


def has_word(text: Column, word: Column) -> Column:
    """C17: whether an identifier stands in a text as a whole word."""
    return F.regexp_like(text, F.concat(F.lit(r"\b"), F.regexp_replace(word, r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"\b")))


def is_view_or_pure(src: Column) -> Column:
    """The word view or pure before the first brace."""
    return F.coalesce(F.substring_index(F.lower(src), "{", 1).rlike(r"\b(view|pure)\b"), F.lit(False))


def writes_any(src: Column, names: Column) -> Column:
    """C20: any of the names followed by an assignment in its line; order is not looked at."""
    # fixed value: the pattern after the name; signs in a name stand for themselves
    plain = lambda v: F.regexp_replace(v, r"([^A-Za-z0-9_])", r"\\$1")
    return F.exists(
        names,
        lambda v: F.regexp_like(src, F.concat(F.lit(r"\b"), plain(v), F.lit(r"\b\s*[\[.]?[^\n]*\s*[+\-*/]?="))),
    )


# What the scan of external calls looks for, without regard to case.
CALL_PATTERNS = [
    r"\.call\s*[\({]", r"\.delegatecall\s*[\({]", r"\.staticcall\s*[\({]", r"\.transfer\s*\(",
    r"\.send\s*\(", r"(?:IERC20|IERC721|IERC1155|ERC20|token|_token)\w*\.\w+\s*\(",
    r"\.safeTransfer\s*\(", r"\.safeTransferFrom\s*\(", r"\.safeApprove\s*\(",
    r"\.safeIncreaseAllowance\s*\(", r"\.safeDecreaseAllowance\s*\(",
    r"I[A-Z]\w+\([^)]*\)\.\w+\s*\(", r"uniswap\w*\.\w+\s*\(", r"router\w*\.\w+\s*\(",
    r"pool\w*\.\w+\s*\(", r"vault\w*\.\w+\s*\(", r"oracle\w*\.\w+\s*\(",
    r"strategy\w*\.\w+\s*\(", r"\w+\.\w+\s*\{[^}]*\}\s*\(",
]


#: A hit of the call patterns holds a member access with an opening bracket after it.
_ANY_CALL = "(?i)" + "|".join(CALL_PATTERNS)


def scan_calls(src: Column) -> Column:
    """All hits of the call patterns in order, without context."""
    return F.regexp_extract_all(src, F.lit(_ANY_CALL), F.lit(0))


def with_context(src: Column, hits: Column, before: int = 40, after: int = 20) -> Column:
    """Each hit of ``scan_calls`` with what stands around it, blanks trimmed and collapsed.

    A hit stands at the first place after the hit before it where its text stands: at an earlier place
    the patterns would have matched too.
    """

    def one(done: Column, hit: Column) -> Column:
        start = F.call_function("locate", hit, src, done["at"]) - 1
        first = F.greatest(start - before, F.lit(0))
        cut = F.substring(src, first + 1, start + F.length(hit) + after - first)
        clean = F.regexp_replace(F.regexp_replace(cut, r"(?U)\A\s+|\s+\z", ""), r"(?U)\s+", " ")
        return F.struct((start + F.length(hit) + 1).alias("at"), F.concat(done["out"], F.array(clean)).alias("out"))

    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(hits, begin, one, lambda done: done["out"])


def apply_edits(src: Column, edits: Column) -> Column:
    """A text with the ranges of ``ARRAY<STRUCT<start, stop, new>>`` (from 0, not overlapping) replaced, from the last
    one to the first, so that no edit moves another. No edits leave the text; null edits give null."""
    last_first = F.array_sort(F.transform(edits, lambda e: F.struct((-e["start"]).alias("o"), e["stop"].alias("stop"), e["new"].alias("new"))))
    cut = lambda s, e: F.concat(F.substring(s, F.lit(1), -e["o"]), e["new"], F.substring(s, e["stop"] + 1, F.length(s)))
    return F.aggregate(last_first, src, cut)


def call_method(call: Column) -> Column:
    """The method of a call text ``a.b[c].method{..}(..)``: the last name before its arguments."""
    return F.regexp_extract(call, r"\.(\w+)\s*(?:\{[^}]*\})?\s*\(", 1)


def call_receiver(call: Column) -> Column:
    """The root name of the receiver (``a`` of ``a.b.c()``, ``I`` of ``I(x).c()``)."""
    return F.regexp_extract(call, r"\A\s*([A-Za-z_$][\w$]*)", 1)
