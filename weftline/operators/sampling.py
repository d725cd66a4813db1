"""Deterministic sampling, quotas and constrained split search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded(key: Column, seed: int = 42) -> Column:
    """The position of a key in a seeded shuffle, by SHA-256; the same in any engine."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle; a bounded top-k without a full sort."""
    order = seeded(F.col(key), seed)
    return df.withColumn("__o", order).orderBy("__o", key).limit(n).drop("__o")


def first_by_group(df: DataFrame, group: str, order: Sequence[str], quota: Column) -> DataFrame:
    """The first rows of each group, as many as ``quota`` (a column constant in a group).

    Only rows up to the quota are kept while sorting: Spark plans a group limit below the shuffle
    where the quota is a literal.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= quota).drop("__rank")


def balanced_quota(pool: DataFrame, positives: DataFrame, flag: str, factor: int = 3) -> DataFrame:
    """One row ``n_true, n_false``: how many of each kind of the pool to draw.

    The kinds keep the ratio of the positives; the scarcer kind bounds both, and the total is at
    most ``factor`` times the positives. Results are cut to whole numbers.
    """
    p = positives.agg(F.count("*").alias("p"), F.avg(F.col(flag).cast("double")).alias("r"))
    have = pool.agg(F.count_if(F.col(flag)).alias("t"), F.count_if(~F.col(flag)).alias("f"))
    return p.join(have).select(
        F.expr(f"""inline(array(struct(
            least(p * {factor}, cast(coalesce(least(try_divide(t, r), try_divide(f, 1 - r)), t + f) as bigint)) as total,
            coalesce(r, 0D) as r, t, f)))""")
    ).select(
        F.expr("least(t, cast(total * r as bigint))").alias("n_true"),
        F.expr("least(f, total - least(t, cast(total * r as bigint)))").alias("n_false"),
    )


def ratio_gate(pool: DataFrame, reference: DataFrame, flag: str, gap: float = 0.25) -> DataFrame:
    """The pool, or nothing of it if its share of ``flag`` is more than ``gap`` off the reference's."""
    one = reference.agg(F.avg(F.col(flag).cast("double")).alias("__r"))
    own = pool.agg(F.avg(F.col(flag).cast("double")).alias("__o"))
    keep = one.join(own).where(f"abs(__r - __o) <= {gap}")
    return pool.join(F.broadcast(keep.select(F.lit(True).alias("__ok")))).drop("__ok")


def split_draw(group: Column, run: Column, shares: Sequence[float] = (0.70, 0.15, 0.15)) -> Column:
    """The split (0, 1, 2, ...) of a group in a run: a uniform draw from a hash of both."""
    u = F.conv(F.substring(F.sha2(F.concat(run.cast("string"), F.lit(":"), group.cast("string")), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, edge = F.lit(len(shares) - 1), 1.0
    for i in range(len(shares) - 2, -1, -1):
        edge = sum(shares[: i + 1])
        out = F.when(u < edge, F.lit(i)).otherwise(out)
    return out


def split_search(groups: DataFrame, runs: int, shares: Sequence[float] = (0.70, 0.15, 0.15), slack: float = 0.05) -> DataFrame:
    """Scores of random assignments of whole groups: ``run, n0, n1, n2, score``, valid runs only.

    ``groups`` has ``grp, pos, neg``. Sums of each run are combined on the map side, so what is
    shuffled is ``runs`` rows a task, whatever the number of groups. A run is valid if each split's
    share of the positives is within ``slack`` of its own; the score is the sum of the deviations of
    both classes. Without a valid run the result is empty.
    """
    drawn = groups.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    drawn = drawn.withColumn("s", split_draw(F.col("grp"), F.col("run"), shares))
    sums = [F.sum(F.when(F.col("s") == i, F.col(c)).otherwise(0)).alias(f"{c}{i}") for c in ("pos", "neg") for i in range(len(shares))]
    total = drawn.groupBy("run").agg(*sums, F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    score, valid = F.lit(0.0), F.lit(True)
    for i, share in enumerate(shares):
        off = F.abs(F.coalesce(F.try_divide(F.col(f"pos{i}"), F.col("pos")), F.lit(0.0)) - share)
        score = score + off + F.abs(F.coalesce(F.try_divide(F.col(f"neg{i}"), F.col("neg")), F.lit(0.0)) - share)
        valid = valid & (off <= slack)
    return total.where(valid).select("run", *[(F.col(f"pos{i}") + F.col(f"neg{i}")).alias(f"n{i}") for i in range(len(shares))], F.round(score, 9).alias("score"))


def constrained_search(
    groups: DataFrame, runs: int, ranges: Mapping[tuple[str, int], tuple[float, float]], wanted: Sequence[tuple[str, str, float]],
    shares: Sequence[float] = (0.70, 0.15, 0.15),
) -> DataFrame:
    """O10 in full: ``run, <sums>, score`` of random assignments of whole groups that keep every hard range.

    ``groups`` has ``grp`` and counts; ``ranges`` bounds the sum of a count in a split, ``(column, split) -> (least,
    most)``; ``wanted`` has ratios to come near in every split, ``(part, whole, share)``. The score is the sum
    over splits of how far each ratio is off; a ratio of nothing is 0. Sums of a run are combined on the map
    side, so what is shuffled is a row a run and task. Without a valid run the result is empty.
    """
    needed = dict.fromkeys([c for c, _ in ranges] + [c for p, w, _ in wanted for c in (p, w)])
    drawn = groups.withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    drawn = drawn.withColumn("__s", split_draw(F.col("grp"), F.col("run"), shares))
    sums = [F.sum(F.when(F.col("__s") == i, F.col(c)).otherwise(0)).alias(f"{c}{i}") for c in needed for i in range(len(shares))]
    total = drawn.groupBy("run").agg(*sums)
    valid, score = F.lit(True), F.lit(0.0)
    for (c, i), (least, most) in ranges.items():
        valid = valid & F.col(f"{c}{i}").between(least, most)
    for part, whole, share in wanted:
        for i in range(len(shares)):
            score = score + F.abs(F.coalesce(F.try_divide(F.col(f"{part}{i}"), F.col(f"{whole}{i}")), F.lit(0.0)) - share)
    bounded = [f"{c}{i}" for c, i in ranges]
    return total.where(valid).select("run", *bounded, F.round(score, 9).alias("score"))


def pick_run(scored: DataFrame, place: int = 6) -> DataFrame:
    """O2: the run at ``place`` in order of score, or the last if there are fewer."""
    ranked = scored.orderBy("score", "run").limit(place)
    return ranked.orderBy(F.desc("score"), F.desc("run")).limit(1)


def union_pools(*pools: DataFrame) -> DataFrame:
    """All rows of all pools; columns that a pool lacks are null."""
    out = pools[0]
    for pool in pools[1:]:
        out = out.unionByName(pool, allowMissingColumns=True)
    return out
