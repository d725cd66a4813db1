"""Overlaps between training and evaluation splits, by texts and by names (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import fulltext, neardup
from weftline.llm.records import file_name, function_name, split_name
from weftline.session import materialize, scratch

#: Shortest run of words that counts as shared text. Where two long texts have 0.6 of all their runs of
#: three words in common, a stretch of shared words is this long at the least: s stretches shorter than
#: that have at most 5 s runs in common and break 2 runs on either side of each of s - 1 gaps between them,
#: and 5 s / (9 s - 4) is below 0.6 from seven stretches (some 50 words) on.
LEAST_WORDS = 8


def split_sides(splits: DataFrame) -> DataFrame:
    """``hyperedge_id, split, source, is_train`` of the rows assigned to a split."""
    return splits.select("hyperedge_id", split_name(F.col("split")).alias("split"), "source").where(
        "split is not null"
    ).withColumn("is_train", F.col("split") == "train")


def _source_groups(tokens: DataFrame, sides: DataFrame, threshold: float, k: int) -> DataFrame:
    """``train_id, eval_id, a, b, spans, covered, longest``: rows of one near-duplicate group on different
    sides, the keys of their texts, and what the two texts share in runs of at least LEAST_WORDS words,
    all 0 if there is none.

    ``tokens`` as from ``tokenized``, with ``hyperedge_id``. Evaluation texts are indexed and training
    texts streamed. Matches whose texts are alike enough are the links across the sides; those within a
    side or to texts of no split, by which a group may be held together, come from the forest.
    """
    with scratch(tokens.sparkSession) as keep:
        sided = materialize(
            tokens.select("id", "hyperedge_id", "w", "tokens").join(sides, "hyperedge_id")
            .select("id", F.col("w").alias("key"), "tokens", "is_train"), "sided",
        )
        matches = fulltext.cross_matches(sided, LEAST_WORDS)
        near = matches.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = neardup.forest_candidates(tokens, threshold, k).unionByName(near).distinct()
        members = neardup.group_members(tokens, neardup.all_links(found, tokens, threshold, k))
        placed = materialize(members.join(sided.select("id", "key", "is_train"), "id"), "placed")
        keep(placed, matches)
    train = placed.where("is_train").select(F.col("id").alias("train_id"), F.col("key").alias("a"), "grp")
    held = placed.where("not is_train").select(F.col("id").alias("eval_id"), F.col("key").alias("b"), "grp")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("spans", "covered", "longest")]
    return train.join(held, "grp").join(matches, ["a", "b"], "left").select("train_id", "eval_id", "a", "b", *counts)


def source_matches(tokens: DataFrame, sides: DataFrame, threshold: float, k: int) -> DataFrame:
    """``id_a, id_b, train_id, eval_id, spans, covered, longest``: rows of one near-duplicate group on
    different sides, with the shared stretches of ``_source_groups``."""
    return _ordered(_source_groups(tokens, sides, threshold, k), "spans", "covered", "longest")


def source_pairs(tokens: DataFrame, sides: DataFrame, threshold: float, k: int) -> DataFrame:
    """``id_a, id_b, train_id, eval_id``: rows of one near-duplicate group on different sides."""
    return source_matches(tokens, sides, threshold, k).select("id_a", "id_b", "train_id", "eval_id")


def name_pairs(hyperedges: DataFrame, sides: DataFrame) -> DataFrame:
    """``id_a, id_b, train_id, eval_id``: hyperedges of one file and function on different sides.

    A name is a text of two symbols, file and function. Names of the evaluation side are indexed,
    those of the training side streamed, and whole matches are compared letter by letter.
    """
    named = (
        hyperedges.select("hyperedge_id", file_name(F.col("file")).alias("f"), function_name(F.col("function")).alias("g"))
        .dropna().distinct().join(sides.select("hyperedge_id", "is_train"), "hyperedge_id")
    )
    named = materialize(named.withColumn("key", F.xxhash64("f", "g")), "named")

    def symbol(c: str):
        # four bytes of a hash, never the end symbol; a clash is sorted out by the exact check
        return F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(c), F.lit((1 << 32) - 3)) + 2), 8, "0"))

    names = named.select("key", "is_train", "f", "g").distinct()
    coded = names.select("key", "is_train", F.concat(symbol("f"), symbol("g")).alias("tokens"))
    hits = fulltext.cross_matches(materialize(coded, "names"), 2, whole=True).select("a", "b").distinct()
    train = named.where("is_train").select(F.col("hyperedge_id").alias("train_id"), "f", "g", F.col("key").alias("a"))
    held = named.where("not is_train").select(F.col("hyperedge_id").alias("eval_id"), F.col("f").alias("f2"), F.col("g").alias("g2"), F.col("key").alias("b"))
    pairs = train.join(hits, "a").join(held, "b").where("f = f2 and g = g2")
    return _ordered(pairs)


def _ordered(pairs: DataFrame, *keep: str) -> DataFrame:
    return pairs.where("train_id <> eval_id").select(
        F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"),
        "train_id", "eval_id", *keep,
    ).distinct()


def overlap_report(pairs: DataFrame, *by: str) -> DataFrame:
    """``kind, <by>, n_pairs, n_records, n_matched, spans, covered, longest``: overlaps with the spans and
    words that the pairs share, the longest match, and the pairs with any match at all. For names these are
    null. ``pairs`` has ``kind, eval_id, spans, covered, longest`` and the columns ``by``."""
    return pairs.groupBy("kind", *by).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("eval_id").alias("n_records"),
        F.sum((F.col("spans") > 0).cast("long")).alias("n_matched"),
        F.sum("spans").alias("spans"), F.sum("covered").alias("covered"), F.max("longest").alias("longest"),
    )
