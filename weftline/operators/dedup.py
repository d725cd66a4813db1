"""Keys and first-wins deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in ``order``, as an aggregate with map-side combining.

    A key that holds a large part of all rows sends one row per task, where a ranking window would
    sort all of them in one. Nulls are a key of their own; ``order`` should be unique, else any of
    the tied rows with the least remaining columns is taken.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    comparable = [c for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    maps = [c for c in rest if c not in comparable]
    if maps:
        raise ValueError(f"map columns cannot be carried: {maps}")
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, *comparable)).alias("__r"))
    return picked.select(*keys, "__r.*").select(*df.columns)


def in_other(df: DataFrame, other: DataFrame, keys: Sequence[str], keep: bool) -> DataFrame:
    """Rows whose key is (``keep``) or is not in ``other``. A null key is in no table."""
    return df.join(other.select(*keys).distinct(), list(keys), "left_semi" if keep else "left_anti")


def retained_and_new(now: DataFrame, before: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``now`` with ``status`` retained or new, in one outer join."""
    seen = before.select(*keys).distinct().withColumn("__seen", F.lit(True))
    return now.join(seen, list(keys), "left").withColumn(
        "status", F.when(F.col("__seen"), "retained").otherwise("new")
    ).drop("__seen")


def shared_keys(df: DataFrame, key: str, group: str) -> DataFrame:
    """A10/A3: keys that stand in more than one group, with the sorted groups and the row count."""
    return (
        df.where(F.col(key).isNotNull()).groupBy(key)
        .agg(F.count_distinct(group).alias("n_groups"), F.count(F.lit(1)).alias("n_rows"))
        .where("n_groups > 1")
    )


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values, whatever their order and repeats."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
