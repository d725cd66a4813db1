"""Classification metrics and thresholds.

Scores are first counted by value, which is exact and combines on the map side; curves are then
running sums over the distinct scores of a group. Rows with a null label or score are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, label: str, score: str, threshold: float, *groups: str) -> DataFrame:
    """Counts, precision, recall and F1 at a threshold (``>=``); 0 for an empty ratio."""
    said, true = F.col(score) >= threshold, F.col(label) == 1
    c = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*groups).agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"),
    )
    p, r = _div(F.col("tp"), F.col("tp") + F.col("fp")), _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": p, "recall": r, "f1": _div(2 * p * r, p + r)})


#: Parts of the range of a unit of scores whose running sums are made side by side.
CURVE_PARTS = 4_096


def _curve(df: DataFrame, label: str, score: str, groups: Sequence[str]) -> DataFrame:
    """Counts of each distinct score with the running and whole sums of its group, from the highest score down.

    Scores are cut into parts, which are summed first; a score then needs the sums of the parts above its
    own and a running sum within it. So no task holds all scores of a group, only those of a part, or the
    sums of the parts.
    """
    by = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*groups, F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n")
    ).withColumn("part", F.floor(F.col("s") * CURVE_PARTS))
    parts = by.groupBy(*groups, "part").agg(F.sum("p").alias("pp"), F.sum("n").alias("pn"))
    above, whole = Window.partitionBy(*groups).orderBy(F.desc("part")), Window.partitionBy(*groups)
    parts = parts.withColumns({
        "p0": F.sum("pp").over(above) - F.col("pp"), "n0": F.sum("pn").over(above) - F.col("pn"),
        "all_pos": F.sum("pp").over(whole), "all_neg": F.sum("pn").over(whole),
    }).drop("pp", "pn")
    same = F.lit(True)
    for i, c in enumerate([*groups, "part"]):
        parts = parts.withColumnRenamed(c, f"__k{i}")
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    joined = by.join(parts, same).drop(*[f"__k{i}" for i in range(len(groups) + 1)])
    down = Window.partitionBy(*groups, "part").orderBy(F.desc("s"))
    return joined.withColumns({"tp": F.col("p0") + F.sum("p").over(down), "fp": F.col("n0") + F.sum("n").over(down)})


def roc_auc(df: DataFrame, label: str, score: str, *groups: str) -> DataFrame:
    """Area under the ROC curve with ties at half, 0 where there is one class only."""
    c = _curve(df, label, score, groups)
    # each positive beats the negatives below its score and half of those at it
    wins = F.sum(F.col("p") * (F.col("all_neg") - F.col("fp") + F.col("n") / 2.0))
    return c.groupBy(*groups).agg(_div(wins, F.first("all_pos") * F.first("all_neg")).alias("roc_auc"))


def pr_auc(df: DataFrame, label: str, score: str, *groups: str) -> DataFrame:
    """Trapezoids under the precision-recall curve, from recall 0 at precision 1."""
    # a point follows from the sums at its score, the point before it from the same without its own counts
    point = lambda tp, fp: (F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0)), _div(tp, F.col("all_pos")))
    prec, rec = point(F.col("tp"), F.col("fp"))
    prec0, rec0 = point(F.col("tp") - F.col("p"), F.col("fp") - F.col("n"))
    area = F.sum((rec - rec0) * (prec + prec0) / 2)
    return _curve(df, label, score, groups).groupBy(*groups).agg(F.coalesce(area, F.lit(0.0)).alias("pr_auc"))


def threshold_at_recall(df: DataFrame, label: str, score: str, recall: float = 0.95, grid: int = 10_000) -> DataFrame:
    """M8: one row ``threshold, recall_at, n_pos``: the highest grid point that keeps ``recall``.

    With k the positives needed, it is the greatest grid point not above the k-th largest positive
    score, found from counts by grid cell (at most ``grid`` + 1 rows). Without positives it is 0.
    """
    cell = F.floor(F.col(score) * grid + F.lit(1e-9)).cast("long")
    pos = df.where((F.col(label) == 1) & F.col(score).isNotNull()).groupBy(cell.alias("cell")).agg(F.count("*").alias("c"))
    down, whole = Window.orderBy(F.desc("cell")), Window.partitionBy()
    run = pos.withColumns({"above": F.sum("c").over(down), "all_pos": F.sum("c").over(whole)})
    ok = run.where(F.col("above") >= F.ceil(F.col("all_pos") * recall - F.lit(1e-9)))
    return ok.agg(
        F.coalesce(F.max("cell") / grid, F.lit(0.0)).alias("threshold"),
        F.coalesce(F.min("above") / F.max("all_pos"), F.lit(0.0)).alias("recall_at"),
        F.coalesce(F.max("all_pos"), F.lit(0)).alias("n_pos"),
    )


def recall_by_type(df: DataFrame, types: DataFrame, kind: str, label: str, score: str, threshold: float) -> DataFrame:
    """Recall of the positives of every type in ``types``; 0 of 0 for a type without any."""
    hit = df.where(F.col(label) == 1).groupBy(kind).agg(
        F.count("*").alias("n"), F.count_if(F.col(score) >= threshold).alias("caught")
    )
    return types.select(kind).distinct().join(hit, kind, "left").select(
        kind, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("caught", F.lit(0)).alias("caught"),
        _div(F.col("caught"), F.col("n")).alias("recall"),
    )


def false_positive_rate(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """Share of a set of negatives at or above a threshold."""
    return df.agg(F.avg((F.col(score) >= threshold).cast("double")).alias("fpr"))


def conclusion(gap: Column, truncated_share: Column) -> Column:
    """What the diagnostics point at."""
    return F.when(gap > 0.15, "source gap").when(truncated_share >= 0.5, "truncation").otherwise("neither")


def review_groups(df: DataFrame, split: str, cross: str, score: str, threshold: float) -> DataFrame:
    """``<split>, <cross>, caught, missed, priority``: items at and below a threshold by group; groups across
    contracts come first, and test before val before train in both kinds."""
    place = F.when(F.col(split) == "test", 1).when(F.col(split) == "val", 2).when(F.col(split) == "train", 3)
    counts = df.groupBy(split, cross).agg(F.count_if(F.col(score) >= threshold).alias("caught"), F.count_if(F.col(score) < threshold).alias("missed"))
    return counts.withColumn("priority", place + F.when(F.col(cross), 0).otherwise(3))
