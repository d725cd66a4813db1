"""Counts, matrices and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """A1."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, key: str, n: int) -> DataFrame:
    """A2: the ``n`` most frequent values (nulls left out), ties by the value."""
    return count_by(df.where(F.col(key).isNotNull()), key).orderBy(F.desc("n"), key).limit(n)


def conditional_counts(df: DataFrame, keys: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """One count for each named condition and group, with the group's size as ``n``."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(name) for name, c in flags.items()]
    )


def matrix(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of each row value by column value; the values are given, so no extra pass is made."""
    out = df.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return out.na.fill(0, list(values))


def spread(df: DataFrame, keys: Sequence[str], value: str, limit: float) -> DataFrame:
    """Least, greatest, exact median and mean of a value, and the share above ``limit``.

    Equal values are counted first with map-side combining, so a hot group sends its distinct
    values only. Nulls are left out; a group of nulls alone has null figures.
    """
    counted = df.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__c"))
    return counted.groupBy(*keys).agg(
        F.sum(F.when(F.col("__v").isNotNull(), F.col("__c")).otherwise(0)).alias("n"),
        F.min("__v").alias("least"), F.max("__v").alias("greatest"),
        F.expr("percentile(__v, 0.5, __c)").alias("middle"),
        F.try_divide(F.sum(F.col("__v") * F.col("__c")), F.sum(F.when(F.col("__v").isNotNull(), F.col("__c")))).alias("mean"),
        F.try_divide(
            F.sum(F.when(F.col("__v") > limit, F.col("__c")).otherwise(0)),
            F.sum(F.when(F.col("__v").isNotNull(), F.col("__c"))),
        ).alias("share_above"),
    )


def funnel(df: DataFrame, stages: Mapping[str, Column]) -> DataFrame:
    """``stage, position, n``: rows that pass each stage and all before it, in one pass."""
    passed, aggregates = F.lit(True), []
    for name, condition in stages.items():
        passed = passed & F.coalesce(condition, F.lit(False))
        aggregates.append(F.count_if(passed).alias(name))
    one = df.agg(*aggregates)
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(s).alias("stage"), F.col(s).alias("n"))
        for i, s in enumerate(stages)
    ])
    return one.select(F.inline(rows))


def spanning_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have more than one value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def class_weight(df: DataFrame, label: str, fallback: float = 1.5) -> DataFrame:
    """Negatives by positives, ``fallback`` without positives."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(F.coalesce(F.try_divide(neg, pos), F.lit(fallback)).alias("weight"))


def matched_terms(df: DataFrame, text: Column, patterns: Sequence[str]) -> DataFrame:
    """P5: rows that each pattern matches; a row counts for each of its patterns."""
    one = df.agg(*[F.count_if(text.rlike(f"(?i){p}")).alias(f"c{i}") for i, p in enumerate(patterns)])
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"c{i}").alias("n")) for i, p in enumerate(patterns)])
    return one.select(F.inline(rows))
