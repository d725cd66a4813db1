"""Readings of the untidy columns that the problems share; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that stand for a missing one, in lower case.
PLACEHOLDERS = ["", "n/a", "na", "unknown", "-", "none", "null", "?", "tbd"]
# The five grades, with the short forms in use for them.
GRADES = {
    "Critical": ["critical", "crit"], "High": ["high"], "Medium": ["medium", "med"],
    "Low": ["low"], "Informational": ["informational", "info"],
}
# White space and separators.
BLANKS = " \t\n\x0b\f\r\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(name: Column) -> Column:
    return F.btrim(name, F.lit(BLANKS))


def named(name: Column) -> Column:
    """``name``, or null where it is a placeholder."""
    return F.when(~name.isin(PLACEHOLDERS), name)


def bundle_number(vfp_id: Column) -> Column:
    """The number in a bundle id; null where there is none."""
    return F.regexp_extract(vfp_id, r"(\d+)", 1).try_cast("bigint")


def file_name(file: Column) -> Column:
    """The bare file name in lower case, without directories and line reference; null for none."""
    whole = F.lower(stripped(file))
    bare = F.regexp_replace(F.regexp_replace(whole, r"#l?\d.*\z", ""), r"\A.*[/\\]", "")
    return F.when(named(whole).isNotNull(), named(stripped(bare)))


def function_name(function: Column) -> Column:
    """The bare function name in lower case, without contract, keyword, parameters and line reference."""
    whole = F.lower(stripped(function))
    bare = F.regexp_replace(F.regexp_replace(whole, r"#.*\z|\(.*\z", ""), r"\Afunction\s+", "")
    bare = stripped(F.regexp_replace(stripped(bare), r"\A.*(?:::|\.)", ""))
    return F.when(named(whole).isNotNull(), named(bare))


def grade(severity: Column) -> Column:
    """One of the five grades, however written; null for any other severity."""
    letters = F.regexp_replace(F.lower(severity), r"severity|risk|[^a-z]", "")
    out = F.lit(None).cast("string")
    for name, forms in GRADES.items():
        out = F.when(letters.isin(forms), F.lit(name)).otherwise(out)
    return out


def split_name(split: Column) -> Column:
    """train, val or test; null for anything else."""
    name = F.lower(stripped(split))
    return F.when(name.isin("train", "val", "test"), name)
