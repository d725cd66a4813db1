"""The queries of the training-data problems and the SQL they can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.rules import vulnerability_type
from weftline.llm import abuse, bpe, canonical, neardup, overlap, packing, pieces, related_splits, target_sample
from weftline.llm.records import grade
from weftline.llm.shingles import tokenized
from weftline.session import materialize


def _read(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return df.select(*columns) if columns else df


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "forge_hyperedge_examples", "example_id", "function_source")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_oversized(_sources(spark, sf), "example_id", "function_source")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Examples that come out of the splitter in more than one piece."""
    return p1_pieces(spark, sf).where("piece_no = 1").select("example_id")


def p1_over(spark: SparkSession, sf: str) -> DataFrame:
    """Every source back from its pieces without what they repeat, with the number of pieces over the limit."""
    return pieces.rebuilt(p1_pieces(spark, sf), "example_id", "function_source", 1200)


#: Runs of three words and a similarity of 0.6, as the problem states them.
RUN, ALIKE = 3, 0.6


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    tokens = tokenized(_sources(spark, sf), "example_id", "function_source")
    return neardup.near_duplicate_groups(tokens, ALIKE, RUN)


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every example with its group, named by the least example_id in it; null for a null or blank source."""
    groups = materialize(_groups(spark, sf), "members")
    least = groups.groupBy("grp").agg(F.min("id").alias("least"))
    named = groups.join(least, "grp").select("id", F.col("least").alias("grp"))
    every = _read(spark, sf, "forge_hyperedge_examples", "example_id")
    return every.join(named, every["example_id"] == named["id"], "left").select("example_id", "grp")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.group_pairs(_groups(spark, sf))


NAMES, SHARES = ("train", "val", "test"), (0.70, 0.15, 0.15)


def _splits(spark: SparkSession, sf: str) -> DataFrame:
    units = related_splits.hyperedge_units(_read(spark, sf, "forge_constructable_hyperedges"))
    return related_splits.swap_search_splits(units.withColumn("grade", grade(F.col("severity"))), "grade", NAMES, SHARES)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of bundles that the search could move only together."""
    rows = _splits(spark, sf).where("bundle is not null").select(F.col("bundle").alias("node"), F.col("unit").alias("component"))
    return related_splits.component_pairs(rows.distinct())


def p3_splits(spark: SparkSession, sf: str) -> DataFrame:
    return _splits(spark, sf).select("hyperedge_id", "unit", "split")


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """How near the splits come to their shares, in all and by grade."""
    return related_splits.split_report(_splits(spark, sf), "grade", NAMES, SHARES)


def p3_torn(spark: SparkSession, sf: str) -> DataFrame:
    """One row: hyperedges placed, bundles and files of which two hyperedges lie in different splits, and
    splits more than a hundredth off their share."""
    placed = _splits(spark, sf)
    torn = lambda c: placed.where(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias(f"torn_{c}s"))
    n = placed.groupBy("split").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("by")
    )
    share = lambda s: F.try_divide(F.coalesce(F.col("by")[s], F.lit(0)), F.col("n_rows"))
    off = sum(F.coalesce((F.abs(share(s) - w) > 0.01).cast("long"), F.lit(0)) for s, w in zip(NAMES, SHARES))
    return n.select("n_rows", off.alias("off_splits")).crossJoin(torn("bundle")).crossJoin(torn("file"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.copy_pairs(canonical.copy_signatures(_sources(spark, sf), "example_id", "function_source"))


def p4_records(spark: SparkSession, sf: str) -> DataFrame:
    signatures = canonical.copy_signatures(_sources(spark, sf), "example_id", "function_source")
    return canonical.collapse_copies(signatures).select(F.col("kept_id").alias("example_id"), "n_copies")


def p4_hash_clashes(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.hash_clashes(canonical.copy_signatures(_sources(spark, sf), "example_id", "function_source"))


def _overlaps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Overlapping pairs of texts (ids of examples) with their matches, of names (ids of hyperedges), and the sides."""
    sides = overlap.split_sides(_read(spark, sf, "split_items"))
    sources = _read(spark, sf, "forge_hyperedge_examples", "example_id", "hyperedge_id", "function_source")
    tokens = tokenized(sources, "example_id", "function_source", "hyperedge_id")
    names = _read(spark, sf, "forge_constructable_hyperedges", "hyperedge_id", "file", "function")
    return overlap.source_matches(tokens, sides, ALIKE, RUN), overlap.name_pairs(names, sides), sides


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    texts, names, _ = _overlaps(spark, sf)
    return texts.select(F.lit("source").alias("kind"), "id_a", "id_b").unionByName(
        names.select(F.lit("name").alias("kind"), "id_a", "id_b")
    )


def _placed_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """All overlapping pairs with the source of the training side and split and source of the other."""
    texts, names, sides = _overlaps(spark, sf)
    examples = _read(spark, sf, "forge_hyperedge_examples", "example_id", "hyperedge_id")
    of = lambda c: examples.select(F.col("example_id").alias(f"{c}_id"), F.col("hyperedge_id").alias(f"{c}_edge"))
    both = texts.join(of("train"), "train_id").join(of("eval"), "eval_id").withColumn("kind", F.lit("source")).unionByName(
        names.withColumns({"kind": F.lit("name"), "train_edge": F.col("train_id"), "eval_edge": F.col("eval_id")}), allowMissingColumns=True
    )
    train = sides.select(F.col("hyperedge_id").alias("train_edge"), F.col("source").alias("train_source"))
    held = sides.select(F.col("hyperedge_id").alias("eval_edge"), "split", "source")
    return both.join(train, "train_edge").join(held, "eval_edge")


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps with their matches by kind, evaluation split and split_items.source."""
    return overlap.overlap_report(_placed_overlaps(spark, sf), "split", "source")


def p5_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Overlaps with their matches by kind, the source of the training side and split and source of the other."""
    return overlap.overlap_report(_placed_overlaps(spark, sf), "train_source", "split", "source")


def p5_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of kind "source" with the spans, words and longest match that the two share."""
    return _overlaps(spark, sf)[0]


def _sampled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _read(spark, sf, "forge_constructable_hyperedges", "hyperedge_id", "severity", "finding_title")
    category = F.concat(grade(F.col("severity")), F.lit("|"), vulnerability_type(F.col("finding_title")))
    # redeliveries repeat the row unchanged, so any of them tells the category
    once = rows.groupBy("hyperedge_id").agg(F.min(F.struct(category.alias("category"))).alias("r"))
    once = once.select("hyperedge_id", "r.category")
    targets = _read(spark, sf, "sample_targets").select(
        "target_id", F.concat("severity", F.lit("|"), "vtype").alias("category"), "target_share", "min_rows"
    )
    return target_sample.sample_to_targets(once, targets, "hyperedge_id", "category")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf)[1].where("not met").select("target_id")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf)[1]


def p6_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf)[0]


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """One row: the sample's rows, repeats among them, targets under their floor though there was stock, and
    targets that are called met but drawn more than one row under their share; the last two are 0 where
    the sample is too small for all floors and shares together."""
    sample, report = _sampled(spark, sf)
    targets = _read(spark, sf, "sample_targets").select("target_id", "min_rows")
    n = sample.agg(F.count(F.lit(1)).alias("n_rows"), (F.count(F.lit(1)) - F.count_distinct("hyperedge_id")).alias("repeats"))
    off = report.join(targets, "target_id").agg(
        F.count_if(F.col("drawn") < F.least("available", "min_rows")).alias("low"),
        F.count_if(F.col("met") & (F.col("drawn") < F.floor("wanted") - 1)).alias("less"),
        F.sum(F.least("available", F.floor("wanted"))).alias("asked"),
    )
    fits = F.coalesce(F.col("asked") <= F.col("n_rows"), F.lit(False))
    return n.crossJoin(off).select(
        "n_rows", "repeats", *[F.when(fits, F.col(c)).otherwise(F.lit(0).cast("long")).alias(a) for c, a in (("low", "under_floor"), ("less", "under_share"))]
    )


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(_read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def p7_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's text back from its ids and their offsets, '' for a null text."""
    encoded = bpe.encode_corpus(_read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", offsets=True)
    return bpe.decode_corpus(encoded, "doc_id")


#: Limits of a container. Code quoted between fences is material for the text around it and bears no loss;
#: the limit on loss-bearing tokens makes every container hold some of such material, or room.
CAPACITY, SEGMENTS, LOSS, QUOTED = 2_048, 256, 2_000, r"```.*?(?:```|\Z)"


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = bpe.count_tokens(_read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text", QUOTED)
    return packing.fill_containers(sizes, "doc_id", "n_tokens", CAPACITY, SEGMENTS, LOSS, "n_loss")


def p8_limits(spark: SparkSession, sf: str) -> DataFrame:
    """The limits held against the containers as they come out."""
    return packing.limits_report(p8_containers(spark, sf), CAPACITY, SEGMENTS, LOSS)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the packer had to cut."""
    return p8_containers(spark, sf).where("piece_no = 1").select("doc_id")


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf))


#: Documents scored at least so high count as abusive.
ABUSE_AT = 0.25


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents", "doc_id", "source", "text")
    weights = abuse.fit_scorer(docs, _read(spark, sf, "abuse_labels"))
    return abuse.score_texts(docs, weights, "doc_id", "text", "source")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_scores(spark, sf).where(F.col("score") >= ABUSE_AT).select("doc_id")


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Every source (null too) with its documents, flagged documents and rate."""
    flagged = F.count_if(F.col("score") >= ABUSE_AT)
    return p9_scores(spark, sf).groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), flagged.alias("n_flagged"),
        (flagged / F.count(F.lit(1))).alias("rate"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_pieces, p1_over, p2_found, p2_groups, p3_found, p3_splits, p3_report, p3_torn, p4_found, p4_records, p4_hash_clashes,
            p5_found, p5_report, p5_matches, p5_sources, p6_found, p6_report, p6_sample, p6_checks, p7_ids, p7_decoded, p8_found, p8_containers, p8_fill, p8_limits,
            p9_found, p9_scores, p9_rates,
        )
    }


def oracle_sql() -> dict[str, str]:
    from weftline.llm.sql import SQL

    return dict(SQL)
