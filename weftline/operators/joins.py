"""Lookups and range joins."""

from __future__ import annotations

import difflib
import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_match(df: DataFrame, candidates: DataFrame, on: Sequence[str], id_col: str, priority: Column, order: Sequence[str], take: Sequence[str]) -> DataFrame:
    """For each row the candidate of least priority, then of least ``order``.

    An equi join on ``on`` followed by an aggregate (map-side combined), so that a row with many
    candidates needs no sort. ``priority`` may use columns of both sides; null means no candidate.
    Rows without a candidate come out with nulls (J2).
    """
    joined = df.join(candidates, list(on), "left").withColumn("__p", priority)
    best = F.min(F.when(F.col("__p").isNotNull(), F.struct("__p", *order, *take))).alias("__b")
    return joined.groupBy(id_col).agg(best).select(id_col, *[F.col(f"__b.{c}").alias(c) for c in take])


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], a_range: tuple[str, str], b_range: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys whose closed ranges meet.

    The key is an equi join; the ranges are its residual. Where a key holds very many ranges, use
    ``overlapping_in_blocks``.
    """
    return a.join(b, list(keys)).where(
        (F.col(a_range[0]) <= F.col(b_range[1])) & (F.col(b_range[0]) <= F.col(a_range[1]))
    )


def overlapping_in_blocks(
    a: DataFrame, b: DataFrame, keys: Sequence[str], a_range: tuple[str, str], b_range: tuple[str, str], width: int, most: int = 16
) -> DataFrame:
    """J4 for hot keys: ranges are cut into blocks of ``width`` lines, which join the key; a pair is
    kept in the block that holds the later of the two starts, so it comes out once. Ranges over more than
    ``most`` blocks, as of a whole file, are not cut but joined by the key alone."""

    def blocks(r: tuple[str, str]) -> tuple[Column, Column]:
        return F.floor(F.col(r[0]) / width), F.floor(F.col(r[1]) / width)

    def part(df: DataFrame, r: tuple[str, str], long: bool) -> DataFrame:
        low, high = blocks(r)
        return df.where((F.col(r[0]) <= F.col(r[1])) & ((high - low >= most) if long else (high - low < most)))

    def cut(df: DataFrame, r: tuple[str, str]) -> DataFrame:
        return part(df, r, False).withColumn("__block", F.explode(F.sequence(*blocks(r))))

    both = overlapping(cut(a, a_range), cut(b, b_range), [*keys, "__block"], a_range, b_range)
    later = F.floor(F.greatest(a_range[0], b_range[0]) / width)
    met = both.where(F.col("__block") == later).drop("__block")
    long_a = overlapping(part(a, a_range, True), b.where(F.col(b_range[0]) <= F.col(b_range[1])), keys, a_range, b_range)
    long_b = overlapping(part(a, a_range, False), part(b, b_range, True), keys, a_range, b_range)
    return met.unionByName(long_a).unionByName(long_b)


def gestalt_ratio(candidate: Column, other: Column) -> Column:
    """similarity of two texts by matching blocks, in the order given; null gives null."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([
            None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)
        ])

    return ratio(candidate, other)


def near_duplicates_of(df: DataFrame, known: DataFrame, id_col: str, block: str, text: str, threshold: float = 0.9) -> DataFrame:
    """Ids of rows whose text is more than ``threshold`` similar to a known one of the same block.

    Equal texts are met by an equi join. Of the others, a pair can pass only if its lengths are within
    ``threshold / (2 - threshold)`` of each other, so texts meet by block and band of lengths, the known ones
    in the bands next to theirs too. The letters they share bound the similarity from above, which leaves
    few pairs to compute. None of these steps loses a pair. Each different text is compared once.
    """
    rows, k = df.select(id_col, block, text).dropna(), known.select(block, F.col(text).alias("__other")).dropna().distinct()
    same = rows.join(k, (rows[block] == k[block]) & (rows[text] == k["__other"]), "left_semi").select(id_col)
    band = lambda c: F.floor(F.log(F.length(c) + 1.0) / math.log((2 - threshold) / threshold)).cast("int")
    texts = rows.select(block, text).distinct().withColumn("__band", band(text))
    near = k.withColumn("__band", F.explode(F.sequence(band("__other") - 1, band("__other") + 1)))
    la, lb = F.length(text), F.length("__other")
    pairs = texts.join(near, [block, "__band"]).where((F.col(text) != F.col("__other")) & (2 * F.least(la, lb) > threshold * (la + lb)))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out, counts = [], {}
        for x, y in zip(a, b):
            cx, cy = (counts.setdefault(t, Counter(t)) for t in (x, y))
            if len(counts) > 10_000:
                counts.clear()
            bound = 2 * sum((cx & cy).values()) / (len(x) + len(y))
            out.append(bound > threshold and difflib.SequenceMatcher(None, x, y).ratio() > threshold)
        return pd.Series(out, dtype=bool)

    close = pairs.where(alike(F.col(text), F.col("__other"))).select(block, text).distinct()
    return same.unionByName(rows.join(close, [block, text], "left_semi").select(id_col)).distinct()


def resolve_owner(calls: DataFrame, contracts: DataFrame, inherited: DataFrame) -> DataFrame:
    """``bundle, file, function, owner``: the contract to which a located function belongs.

    ``calls`` has ``bundle, file, function`` (repeats count once), ``contracts`` ``bundle, file, ord, name, kind,
    functions`` (names of its own, ``ord`` unique in a bundle), ``inherited`` ``bundle, name, functions`` with all
    names that a contract has or inherits. The first of these that exists is taken: a contract of the file
    with the function (one that is no interface or library first), a contract of the file that inherits it, the
    same two over the bundle, the last contract of the file, the last of the bundle. The last two may
    lack the function. Without any the owner is null.
    """
    at = calls.select("bundle", "file", "function").dropna().distinct()
    c = contracts.select("bundle", F.col("file").alias("__f"), "ord", "name", "kind", F.col("functions").alias("__own"))
    c = c.join(inherited.select("bundle", "name", F.col("functions").alias("__all")), ["bundle", "name"], "left")
    both = at.join(c, "bundle", "left")
    here, solid = F.col("__f") == F.col("file"), F.col("kind") == "contract"
    has, may = F.array_contains("__own", F.col("function")), F.coalesce(F.array_contains("__all", F.col("function")), F.lit(False))
    step = (
        F.when(here & has, 1).when(here & solid & may, 2).when(has, 3).when(solid & may, 4)
        .when(here & solid, 5).when(solid, 6)
    )
    place = F.when(step <= 4, F.col("ord")).otherwise(-F.col("ord"))
    best = F.min(F.when(step.isNotNull(), F.struct(step.alias("s"), (~solid).alias("n"), place.alias("p"), "name")))
    return both.groupBy("bundle", "file", "function").agg(best["name"].alias("owner"))


def resolve_bundle(items: DataFrame, content: DataFrame, files: DataFrame, key: Sequence[str]) -> DataFrame:
    """``file, <key>, bundle, step`` for each different item: the bundle it comes from, verified by hash.

    ``items`` has ``file`` and the key (names and hash), ``content`` ``bundle, file`` and the key of what stands in
    each bundle, ``files`` ``bundle, file``. The first that exists is taken, of several bundles the least: a bundle
    with the key in that file (1), one with the file and the key in any file (2), one with the file (3). Items
    and contents are made distinct before they meet, so copies do not multiply.
    """
    one = items.select("file", *key).distinct()
    there = content.select("bundle", *key).distinct()
    direct = content.groupBy("file", *key).agg(F.min("bundle").alias("__b1"))
    held = files.select("bundle", "file").distinct()
    second = one.join(there, list(key)).join(held, ["bundle", "file"], "left_semi").groupBy("file", *key).agg(F.min("bundle").alias("__b2"))
    third = held.groupBy("file").agg(F.min("bundle").alias("__b3"))
    found = one.join(direct, ["file", *key], "left").join(second, ["file", *key], "left").join(third, "file", "left")
    step = F.when(F.col("__b1").isNotNull(), 1).when(F.col("__b2").isNotNull(), 2).when(F.col("__b3").isNotNull(), 3)
    return found.select("file", *key, F.coalesce("__b1", "__b2", "__b3").alias("bundle"), step.alias("step"))


def file_bundle(items: DataFrame, content: DataFrame, files: DataFrame, key: Sequence[str]) -> DataFrame:
    """``file, <key>, bundle``: of the bundles with the key the least that has the file, else the least
    bundle with the file."""
    one, held = items.select("file", *key).distinct(), files.select("bundle", "file").distinct()
    keyed = one.join(content.select("bundle", *key).distinct(), list(key)).join(held, ["bundle", "file"], "left_semi")
    first, any_ = keyed.groupBy("file", *key).agg(F.min("bundle").alias("__k")), held.groupBy("file").agg(F.min("bundle").alias("__a"))
    return one.join(first, ["file", *key], "left").join(any_, "file", "left").select("file", *key, F.coalesce("__k", "__a").alias("bundle"))


def tiers(df: DataFrame, positives: DataFrame, file: str) -> DataFrame:
    """Tier A for rows whose file has a positive, else B."""
    seen = positives.select(file).distinct().withColumn("__a", F.lit(True))
    return df.join(seen, file, "left").withColumn("tier", F.when(F.col("__a"), "A").otherwise("B")).drop("__a")


def gather_by_text(df: DataFrame, text: str, encode, schema: str = "array<float>") -> DataFrame:
    """``df`` with ``vector``; each distinct text is encoded once, in Arrow batches.

    ``encode`` takes a list of texts and gives a list of vectors. Null texts have a null vector.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(vector=list(encode(pdf["__t"].tolist())))

    vectors = df.select(F.col(text).alias("__t")).dropna().distinct().mapInPandas(run, f"__t string, vector {schema}")
    return df.join(vectors, F.col(text) == F.col("__t"), "left").drop("__t")


def cross_contract(calls: DataFrame, contracts: DataFrame, id_col: str) -> DataFrame:
    """C11 over tables: the ids with a call to a contract of their bundle other than their own. ``calls`` has
    ``<id_col>, bundle, own, target``, one row a call; ``contracts`` has ``bundle, name``. A null own name is none."""
    targets = calls.where("target is not null and not target <=> own").select(id_col, "bundle", F.regexp_replace("target", r"[\[\]]+\z", "").alias("name"))
    return targets.join(contracts.select("bundle", "name").distinct(), ["bundle", "name"], "left_semi").select(id_col).distinct()


def predictions_for(rows: DataFrame, predicted: DataFrame, key: Sequence[str], order: str, value: str, wanted: Column) -> DataFrame:
    """``rows`` with ``value`` of the last of ``predicted`` (by ``order``) with the same key, null where ``wanted``
    does not hold. Nulls in a key match no prediction."""
    last = predicted.groupBy(*key).agg(F.max_by(value, order).alias("__v"))
    joined = rows.drop(value).join(last, list(key), "left")
    return joined.withColumn(value, F.when(wanted, F.col("__v"))).drop("__v")


def node_features(items: DataFrame, id_col: str, text: str, lists: Sequence[str], encode, schema: str = "array<float>") -> DataFrame:
    """M2: ``<id_col>, nodes``: the vectors of an item's own text and of the texts in its list columns, as an array of
    ``kind, pos, vector`` in that order. Each different text is encoded once, over all kinds (M1); items
    without a text are skipped, null texts in lists left out."""
    own = items.where(F.col(text).isNotNull())
    parts = [own.select(id_col, F.lit(0).alias("kind"), F.lit(0).alias("pos"), F.col(text).alias("__text"))]
    parts += [own.select(id_col, F.lit(i + 1).alias("kind"), F.posexplode(c).alias("pos", "__text")) for i, c in enumerate(lists)]
    nodes = parts[0]
    for p in parts[1:]:
        nodes = nodes.unionByName(p)
    vectors = gather_by_text(nodes.where("__text is not null"), "__text", encode, schema)
    # one item's nodes: as many as its own lists are long
    return vectors.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("kind", "pos", "vector"))).alias("nodes"))
