"""Splits that keep related records together (problem 3).

Bundles joined by files form components; whole components are given to splits. A component swap
search starts from a hashed assignment and exchanges or moves components by annealing, several
chains in parallel, and keeps the best. Components are dealt to shards by hash, each annealed towards
its own rows in the given shares, and in further turns towards what all shards together are off.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.records import bundle_number, file_name
from weftline.operators.components import connected_components, star_edges
from weftline.session import materialize, scratch

#: Components of one shard on average; bounds the table of one chain, whatever the input.
SHARD_UNITS = 8_192
#: Proposals of a chain for each unit, where that is more than its least number of steps.
UNIT_STEPS = 10


def bundle_components(df: DataFrame, bundle: str, file: str) -> DataFrame:
    """``node, component`` of bundles that share a file with another, directly or through others."""
    return connected_components(star_edges(df, bundle, file))


def related_units(rows: DataFrame, id_col: str, bundle: str, file: str) -> DataFrame:
    """``rows`` with ``unit``, a string equal for all rows that must stay together.

    A row belongs to the component of its bundle; a row without a bundle to that of a bundle with
    its file; if there is none, to its file; without both it stands alone. Written to the shared
    folder.
    """
    with scratch(rows.sparkSession) as keep:
        links = rows.select(F.col(bundle).alias("__b"), F.col(file).alias("__f"))
        comp = materialize(bundle_components(links, "__b", "__f"), "bundles")
        by_file = materialize(
            links.dropna().groupBy("__f").agg(F.min("__b").alias("__fb")), "filebundle"
        )
        lone = rows.where(F.col(bundle).isNull()).join(by_file, F.col(file) == F.col("__f"), "left").drop("__f")
        own = rows.where(F.col(bundle).isNotNull()).withColumn("__fb", F.col(bundle))
        both = own.unionByName(lone).join(comp, F.col("__fb") == F.col("node"), "left")
        unit = F.coalesce(
            F.concat(F.lit("b"), F.coalesce("component", "__fb")), F.concat(F.lit("f"), F.col(file)),
            F.concat(F.lit("r"), F.col(id_col).cast("string")),
        )
        units = materialize(both.withColumn("unit", unit).drop("node", "component", "__fb"), "units")
        keep(units)
    return units


def _search(
    sizes: np.ndarray, shares: np.ndarray, start: np.ndarray, seed: int, steps: int, target: np.ndarray | None = None
) -> tuple[float, np.ndarray]:
    """Annealed moves and exchanges; returns the least deviation and its assignment.

    sizes: units x (1 + labels), rows and rows by label. The deviation is the sum over splits of
    the share of rows off target, and of every label's share off target weighted by the label. The
    target (splits x (1 + labels)) is the given shares of all, if none is given.
    Half of the proposals choose a unit in proportion to its rows, half any unit. There are at least
    ``steps`` proposals, or UNIT_STEPS for each unit if that is more; none if ``steps`` is 0.
    """
    rng, k, n = np.random.default_rng(seed), len(shares), len(sizes)
    total = sizes.sum(0)
    weight = np.r_[1.0, total[1:] / max(total[0], 1) * 0.5]
    target = shares[:, None] * total[None, :] if target is None else target
    scale = weight / np.maximum(total, 1)
    have = np.zeros((k, sizes.shape[1]))
    np.add.at(have, start, sizes)
    now = start.copy()
    cost = (np.abs(have - target) * scale).sum()
    best, kept = cost, now.copy()
    steps = max(steps, UNIT_STEPS * n) if steps else 0
    drawn = np.cumsum(sizes[:, 0])
    for step in range(steps if n > 1 else 0):
        heat = 0.02 * (1 - step / steps) ** 3
        i = rng.integers(n)
        if rng.random() < 0.5:
            i = min(int(np.searchsorted(drawn, rng.random() * drawn[-1], side="right")), n - 1)
        to = rng.integers(k)
        if to == now[i]:
            continue
        j = rng.integers(n) if rng.random() < 0.5 else -1
        moved = sizes[i] - sizes[j] if j >= 0 and now[j] == to else sizes[i]
        new = have.copy()
        new[now[i]] -= moved
        new[to] += moved
        c = (np.abs(new - target) * scale).sum()
        if c <= cost or rng.random() < np.exp((cost - c) / max(heat * 0.05, 1e-12)):
            if j >= 0 and now[j] == to:
                now[j] = now[i]
            now[i], have, cost = to, new, c
            if c < best - 1e-15:
                best, kept = c, now.copy()
    return float(best), kept


def swap_search_splits(
    units: DataFrame, label: str, names: Sequence[str] = ("train", "val", "test"),
    shares: Sequence[float] = (0.70, 0.15, 0.15), chains: int = 6, steps: int = 20_000,
    labels: int = 8, turns: int = 4, near: float = 0.001,
) -> DataFrame:
    """``units`` (with ``unit``) with ``split``.

    The ``labels`` most frequent values of ``label`` are balanced, the others together; a null
    label counts as a value. Every component moves on its own, within its shard of SHARD_UNITS
    components on average; of the ``chains`` of a shard the best is kept. In further turns, as long as
    they help and the deviation is above ``near``, each shard takes over an equal part, by its components, of what the splits of all shards
    are off, which is where a component too large for its shard is made up for. Only sums by split and label (a bounded table)
    come to the driver. Deterministic for given rows. No row is dropped; a column ``split`` is replaced; an empty table stays
    empty.
    """
    spark = units.sparkSession
    value = F.coalesce(F.col(label).cast("string"), F.lit("\0"))
    shares_a = np.array(shares, float) / sum(shares)
    with scratch(spark) as keep:
        top = [r[0] for r in units.groupBy(value.alias("v")).count().orderBy(F.desc("count"), "v").limit(labels).collect()]
        counts = [F.count(F.lit(1)).alias("c0")] + [F.count_if(value == v).alias(f"c{i + 1}") for i, v in enumerate(top)]
        cs = [f"c{i}" for i in range(len(counts))]
        sized = materialize(units.groupBy("unit").agg(*counts), "sized")
        units_n = sized.count()
        shards = max(1, -(-units_n // SHARD_UNITS))
        placed = sized.withColumn("shard", F.pmod(F.xxhash64("unit"), F.lit(shards))).withColumn("place", F.lit(-1))
        best, least, have = None, np.inf, np.zeros(0)
        for turn in range(turns):
            off = None if best is None else shares_a[:, None] * have.sum(0) - have

            def chain(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values("unit", ignore_index=True)
                size, seed = pdf[cs].to_numpy(float), int(pdf["chain"].iloc[0])
                start = pdf["place"].to_numpy()
                target = shares_a[:, None] * size.sum(0)
                if turn == 0:
                    start = np.searchsorted(np.cumsum(shares_a)[:-1], pdf["spot"].to_numpy(), side="right")
                else:
                    own = np.zeros((len(shares_a), len(cs)))
                    np.add.at(own, start, size)
                    target = own + off * (len(size) / units_n)
                cost, got = _search(size, shares_a, start, seed + turn * chains, steps, target)
                return pd.DataFrame({"shard": pdf["shard"], "chain": seed, "cost": cost, "unit": pdf["unit"], "place": got})

            spot = (F.pmod(F.xxhash64("unit", "chain"), F.lit(1 << 30)) / float(1 << 30)).alias("spot")
            tried = (
                placed.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).select("*", spot)
                .repartition(min(shards * chains, 100_000), "shard", "chain")
                .groupBy("shard", "chain").applyInPandas(chain, "shard long, chain int, cost double, unit string, place int")
            )
            tried = materialize(tried, "chains")
            won = tried.groupBy("shard").agg(F.min(F.struct("cost", "chain"))["chain"].alias("chain"))
            chosen = tried.join(won, ["shard", "chain"]).select("unit", "place")
            after = materialize(sized.join(chosen, "unit").withColumn("shard", F.pmod(F.xxhash64("unit"), F.lit(shards))), "placed")
            sums = after.groupBy("place").agg(*[F.sum(c) for c in cs]).collect()
            have = np.zeros((len(shares_a), len(cs)))
            for r in sums:
                have[r[0]] = [float(x) for x in r[1:]]
            rows = max(have[:, 0].sum(), 1.0)
            weight = np.r_[1.0, have.sum(0)[1:] / rows * 0.5] / np.maximum(have.sum(0), 1)
            cost = float((np.abs(have - shares_a[:, None] * have.sum(0)) * weight).sum())
            if cost >= least:
                break
            best, least, placed = after, cost, after
            if cost <= near:
                break
        split = F.get(F.array(*[F.lit(n) for n in names]), F.col("place")).alias("split")
        by_unit = materialize(best.select("unit", split), "unitsplit")
        keep(by_unit)
    return units.drop("split").join(by_unit, "unit")


def split_report(splits: DataFrame, label: str, names: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``label, split, n, share, wanted`` of the rows of all labels (null) and of each label value: how
    near the search came to the given shares. A null label value counts as ''."""
    value = F.coalesce(F.col(label).cast("string"), F.lit(""))
    each = splits.select(value.alias("label"), "split").groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))
    every = each.groupBy("split").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("label"), "split", "n")
    both = every.unionByName(each)
    total = both.groupBy(F.coalesce("label", F.lit("\0")).alias("__l")).agg(F.sum("n").alias("__t"))
    wanted = F.lit(None).cast("double")
    for name, share in zip(names, shares):
        wanted = F.when(F.col("split") == name, F.lit(float(share))).otherwise(wanted)
    return both.join(total, F.coalesce("label", F.lit("\0")) == F.col("__l")).select("label", "split", "n", (F.col("n") / F.col("__t")).alias("share"), wanted.alias("wanted"))


def component_pairs(components: DataFrame) -> DataFrame:
    """``vfp_no_a, vfp_no_b``: all pairs of bundles in one component, smaller first."""
    a = components.select(F.col("node").alias("vfp_no_a"), "component")
    b = components.select(F.col("node").alias("vfp_no_b"), "component")
    return a.join(b, "component").where("vfp_no_a < vfp_no_b").select("vfp_no_a", "vfp_no_b")


def hyperedge_units(hyperedges: DataFrame) -> DataFrame:
    """``hyperedge_id, severity, bundle, file, unit``, each hyperedge once (the last delivery)."""
    once = hyperedges.groupBy("hyperedge_id").agg(
        F.max(F.struct("ingested_at", "vfp_id", "file", "severity")).alias("r")
    )
    tidy = once.select(
        "hyperedge_id", F.col("r.severity").alias("severity"),
        bundle_number(F.col("r.vfp_id")).alias("bundle"), file_name(F.col("r.file")).alias("file"),
    )
    return related_units(tidy, "hyperedge_id", "bundle", "file")
