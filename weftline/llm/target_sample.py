"""A sample that matches target category proportions (problem 6).

Swap repair on counts: start from a random sample that meets the floors, group records by
category signature, exchange signature counts while that lowers the deviation from the targets,
and draw the records of each signature at random in the end. Only counts by signature (a bounded
number) reach the driver; the draw itself never sorts a category.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import materialize

BINS = 4_096


def repair_counts(
    have: np.ndarray, target: np.ndarray, floor: np.ndarray, size: int, seed: int = 0
) -> np.ndarray:
    """How many to draw of each signature: at most ``have``, ``size`` in all if there are as many.

    Starts from the floors filled up by a random draw of the rest, then moves counts from
    one signature to another by the largest step that lowers the sum of absolute deviations from
    ``target * size``, until none does. The floors hold wherever ``have`` allows.
    """
    rng = np.random.default_rng(seed)
    low = np.minimum(have, floor)
    size = int(min(size, have.sum()))
    if low.sum() > size:  # more floor than sample: the smallest floors first
        order, left = np.argsort(low, kind="stable"), size
        for i in order:
            low[i] = min(low[i], left)
            left -= low[i]
    n = low.copy().astype(np.int64)
    while (short := size - int(n.sum())) > 0:
        # each record left falls to a category by what that has left, and what exceeds its stock falls again
        rest = have - n
        n = np.minimum(n + rng.multinomial(short, rest / rest.sum()), have)
    want = target * size
    while True:
        over, under = n - want, want - n
        give, take = np.minimum(over, n - low), np.minimum(under, have - n)
        best, move = 1e-9, None
        for i in np.flatnonzero(n > low):
            for j in np.flatnonzero(n < have):
                if i == j:
                    continue
                step = max(1, int(min(give[i], take[j]))) if give[i] > 0 and take[j] > 0 else 1
                gain = abs(over[i]) - abs(over[i] - step) + abs(under[j]) - abs(under[j] - step)
                if gain > best:
                    best, move = gain, (i, j, step)
        if move is None:
            return n
        i, j, step = move
        n[i] -= step
        n[j] += step


def targets_met(have: np.ndarray, share: np.ndarray, floor: np.ndarray, size: int) -> np.ndarray:
    """Whether each category has as many records as the larger of its floor and its share of the sample.
    Of one that has not, the repair leaves nothing undrawn."""
    return have >= np.maximum(floor, share * size)


def draw_by_counts(rows: DataFrame, key: str, id_col: str, quota: DataFrame, seed: int = 42) -> DataFrame:
    """The ``n`` rows of least seeded hash of each ``key``, exactly, by ``quota`` (``key, n``).

    A histogram of hash bins, combined on the map side, tells which bin of each key holds the last
    row drawn; all rows of lower bins are taken, and only that bin is ranked. ``quota`` is a table
    of one row per category; its size and that of the bins decide whether they are broadcast.
    """
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    hashed = rows.withColumn("__h", h).withColumn("__bin", F.shiftrightunsigned("__h", 52))
    upto = Window.partitionBy(key).orderBy("__bin")
    bins = (
        hashed.groupBy(key, "__bin").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("sum", F.sum("c").over(upto)).join(quota, key)
        .where(F.expr("sum - c < n and sum >= n")).select(key, F.col("__bin").alias("edge"), F.expr("n - (sum - c)").alias("left"))
    )
    everything = quota.join(
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("have")), key
    ).where("n >= have").select(key, F.lit(BINS).cast("bigint").alias("edge"), F.lit(0).cast("bigint").alias("left"))
    edges = bins.join(everything.select(key), key, "left_anti").unionByName(everything)
    marked = hashed.join(edges, key)
    sure = marked.where("__bin < edge")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("__h", id_col))
    last = marked.where("__bin = edge").withColumn("__r", rank).where("__r <= left").drop("__r")
    return sure.unionByName(last).drop("__h", "__bin", "edge", "left")


def sample_to_targets(
    rows: DataFrame, targets: DataFrame, id_col: str, key: str, share: float = 0.1, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """The sample (rows of ``rows``) and the report.

    ``rows`` holds each record once with its category ``key`` (null = no category); ``targets``
    has ``target_id, key, target_share, min_rows``, one row per category (a bounded table). The
    sample has ``floor(share * rows)`` records; records without a category enter only where the
    categories have too few. The report has ``target_id, available, wanted, drawn, met``: a target
    is not met if its category has fewer records than the larger of ``min_rows`` and its share of
    the sample. All of its records are then in the sample.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "pool")
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    full = targets.join(counted, key, "full_outer").select(
        "target_id", key, "target_share", "min_rows", "have"
    ).collect()
    full.sort(key=lambda r: (r["target_id"] is None, r["target_id"] or 0, r[key] or ""))
    have = np.array([r["have"] or 0 for r in full], np.int64)
    # a full outer join leaves null keys unmatched, so the records without a category have a row
    size = int(have.sum() * share + 1e-9)
    wish = np.array([r["target_share"] or 0.0 for r in full])
    floor = np.array([r["min_rows"] or 0 for r in full], np.int64)
    n = repair_counts(have, wish, floor, size, seed) if len(full) else have
    met = targets_met(have, wish, floor, size)
    report = [
        (r["target_id"], int(h), float(max(f, w * size)), int(k), bool(m))
        for r, h, f, w, k, m in zip(full, have, floor, wish, n, met)
        if r["target_id"] is not None
    ]
    report_df = spark.createDataFrame(report, "target_id int, available long, wanted double, drawn long, met boolean")
    filled = rows.withColumn("__k", F.coalesce(F.col(key), F.lit("\0")))
    quota = spark.createDataFrame(
        [(r[key] if r[key] is not None else "\0", int(k)) for r, k in zip(full, n) if k > 0], "__k string, n long"
    )
    return draw_by_counts(filled, "__k", id_col, quota, seed).drop("__k"), report_df
