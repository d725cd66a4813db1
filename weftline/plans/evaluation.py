"""Metrics, thresholds, diagnostics and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import metrics
from weftline.plans.registry import query, table

# A deterministic score of each judged document stands for a model's: a hash, shifted by the label.
_SCORED = """
WITH l AS (SELECT doc_id, CAST(round(avg(abusive)) AS INTEGER) AS label FROM abuse_labels GROUP BY 1),
s AS (SELECT doc_id, label, source, n_chars, floor(((('0x' || left(sha256('s:' || doc_id), 6))::BIGINT % 1000) + 250 * label) / 1.25) / 1000 AS score FROM l JOIN documents USING (doc_id))
"""


def scored(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "abuse_labels").groupBy("doc_id").agg(F.round(F.avg("abusive")).cast("int").alias("label"))
    docs = table(spark, sf, "documents", "doc_id", "source", "n_chars")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("s:"), F.col("doc_id").cast("string")), 256), 1, 6), 16, 10).cast("long")
    score = F.floor((F.pmod(h, F.lit(1000)) + 250 * F.col("label")) / 1.25) / 1000
    return labels.join(docs, "doc_id").select("doc_id", "label", "source", "n_chars", score.alias("score"))


@query(_SCORED + """, c AS (SELECT source, count_if(score >= 0.5 AND label = 1) AS tp, count_if(score >= 0.5 AND label = 0) AS fp,
  count_if(score < 0.5 AND label = 1) AS fn, count_if(score < 0.5 AND label = 0) AS tn FROM s GROUP BY 1),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM c)
SELECT source, tp, fp, fn, tn, round(p, 6) AS "precision", round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM r""")
def f01_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """A14, A15, M7, M9."""
    out = metrics.confusion(scored(spark, sf), "label", "score", 0.5, "source")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(_SCORED + """, p AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM s WHERE label = 1),
t AS (SELECT CAST(floor(score * 10000 + 1e-9) AS BIGINT) AS cell, n FROM p WHERE r = ceil(0.95 * n - 1e-9))
SELECT cell / 10000 AS threshold, round((SELECT count(*) FROM s WHERE label = 1 AND floor(score * 10000 + 1e-9) >= cell) / n, 6) AS recall_at, n AS n_pos FROM t""")
def f02_threshold_at_recall(spark: SparkSession, sf: str) -> DataFrame:
    """M8."""
    return metrics.threshold_at_recall(scored(spark, sf), "label", "score").withColumn("recall_at", F.round("recall_at", 6))


@query(_SCORED + """, r AS (SELECT source, label, (rank() OVER (PARTITION BY source ORDER BY score) + (rank() OVER (PARTITION BY source ORDER BY score) + count(*) OVER (PARTITION BY source, score) - 1)) / 2.0 AS rk FROM s),
u AS (SELECT source, sum(CASE WHEN label = 1 THEN rk END) AS sr, count_if(label = 1) AS p, count_if(label = 0) AS n FROM r GROUP BY 1)
SELECT source, round(coalesce((sr - p * (p + 1) / 2.0) / nullif(p * n, 0), 0), 6) AS roc_auc FROM u""")
def f03_roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    """By mean ranks; one class only gives 0."""
    return metrics.roc_auc(scored(spark, sf), "label", "score", "source").withColumn("roc_auc", F.round("roc_auc", 6))


@query(_SCORED + """, g AS (SELECT source, score, sum(label) AS p, count(*) - sum(label) AS n FROM s GROUP BY 1, 2),
c AS (SELECT source, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY source) AS pp FROM g WINDOW w AS (PARTITION BY source ORDER BY score DESC)),
q AS (SELECT source, score, tp / (tp + fp) AS prec, coalesce(tp / nullif(pp, 0), 0) AS rec FROM c),
z AS (SELECT source, prec, rec, lag(prec, 1, 1) OVER w AS prec0, lag(rec, 1, 0) OVER w AS rec0 FROM q WINDOW w AS (PARTITION BY source ORDER BY score DESC))
SELECT source, round(sum((rec - rec0) * (prec + prec0) / 2), 6) AS pr_auc FROM z GROUP BY 1""")
def f04_pr_auc(spark: SparkSession, sf: str) -> DataFrame:
    """A16."""
    return metrics.pr_auc(scored(spark, sf), "label", "score", "source").withColumn("pr_auc", F.round("pr_auc", 6))


@query(_SCORED + """, h AS (SELECT source, count(*) AS n, count_if(score >= 0.5) AS caught FROM s WHERE label = 1 GROUP BY 1)
SELECT d.source, coalesce(n, 0) AS n, coalesce(caught, 0) AS caught, round(coalesce(caught / n, 0), 6) AS recall
FROM (SELECT DISTINCT source FROM documents) d LEFT JOIN h ON d.source = h.source""")
def f05_recall_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Recall by source, with a row for sources without positives."""
    types = table(spark, sf, "documents", "source")
    return metrics.recall_by_type(scored(spark, sf), types, "source", "label", "score", 0.5).withColumn("recall", F.round("recall", 6))


@query(_SCORED + "SELECT round(avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS fpr FROM s WHERE label = 0")
def f06_false_positive_rate(spark: SparkSession, sf: str) -> DataFrame:
    """A18, M10."""
    return metrics.false_positive_rate(scored(spark, sf).where("label = 0"), "score", 0.5).select(F.round("fpr", 6).alias("fpr"))


@query(_SCORED + """, r AS (SELECT source, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS recall FROM s WHERE label = 1 GROUP BY 1),
m AS (SELECT avg(CASE WHEN n_chars > 256 THEN 1.0 ELSE 0.0 END) AS t FROM s WHERE label = 1 AND score < 0.5)
SELECT round(max(recall) - min(recall), 6) AS gap, round(max(t), 6) AS truncated_misses,
  CASE WHEN max(recall) - min(recall) > 0.15 THEN 'source gap' WHEN max(t) >= 0.5 THEN 'truncation' ELSE 'neither' END AS verdict FROM r, m""")
def f07_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """The gap of recall between sources, long texts among the misses, and the verdict."""
    pos = scored(spark, sf).where("label = 1")
    hit = F.avg((F.col("score") >= 0.5).cast("double"))
    gap = pos.groupBy("source").agg(hit.alias("r")).agg((F.max("r") - F.min("r")).alias("gap"))
    # a miss without a length counts as short
    misses = pos.where("score < 0.5").agg(F.avg(F.when(F.col("n_chars") > 256, 1.0).otherwise(0.0)).alias("t"))
    return gap.join(misses).select(
        F.round("gap", 6).alias("gap"), F.round("t", 6).alias("truncated_misses"), metrics.conclusion(F.col("gap"), F.col("t")).alias("verdict")
    )


@query("""SELECT count_if(len(embedding) <> 64 OR embedding IS NULL) AS bad_dims, count_if(vec_id IS NULL) AS null_keys, count(*) - count(DISTINCT vec_id) AS repeated_keys FROM embeddings""")
def f08_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """All counts in one pass; any above zero is a fault."""
    return table(spark, sf, "embeddings").agg(
        F.count_if(F.coalesce(F.size("embedding") != 64, F.lit(True))).alias("bad_dims"),
        F.count_if(F.col("vec_id").isNull()).alias("null_keys"),
        (F.count(F.lit(1)) - F.count_distinct("vec_id")).alias("repeated_keys"),
    )


@query("""SELECT count_if(h.hyperedge_id IS NULL) AS missing_hyperedge, count_if(e.function_source IS NULL OR trim(e.function_source) = '') AS missing_source,
  count_if(NOT contains(lower(e.function_source), lower(e.function))) AS name_mismatch
FROM forge_hyperedge_examples e LEFT JOIN (SELECT DISTINCT hyperedge_id FROM forge_constructable_hyperedges) h USING (hyperedge_id)""")
def f09_reresolution(spark: SparkSession, sf: str) -> DataFrame:
    """Examples whose hyperedge, source or function name cannot be found again."""
    e = table(spark, sf, "forge_hyperedge_examples", "hyperedge_id", "function_source", "function")
    h = table(spark, sf, "forge_constructable_hyperedges", "hyperedge_id").distinct().withColumn("there", F.lit(True))
    return e.join(h, "hyperedge_id", "left").agg(
        F.count_if(F.col("there").isNull()).alias("missing_hyperedge"),
        F.count_if(F.col("function_source").isNull() | (F.trim("function_source") == "")).alias("missing_source"),
        F.count_if(~F.lower("function_source").contains(F.lower("function"))).alias("name_mismatch"),
    )


_CROSS = r"""WITH h AS (SELECT DISTINCT hyperedge_id, regexp_replace(list_last(string_split(trim(file), '/')), '\.[^.]*$', '') AS own, external_calls AS ec FROM forge_constructable_hyperedges),
x AS (SELECT hyperedge_id, coalesce(len(list_filter(ec, lambda c: regexp_extract(c, '^\s*([A-Za-z_$][\w$]*)', 1) NOT IN ('', 'this') AND regexp_extract(c, '^\s*([A-Za-z_$][\w$]*)', 1) <> own)) > 0, false) AS is_cross FROM h),
s AS (SELECT x.hyperedge_id, lower(trim(split)) AS split, is_cross, (('0x' || left(sha256('s:' || x.hyperedge_id), 6))::BIGINT % 1000) / 1000 AS score
  FROM x JOIN split_items USING (hyperedge_id) WHERE split IS NOT NULL AND label = 1)
"""


def _reviewed(spark: SparkSession, sf: str) -> DataFrame:
    """``hyperedge_id, split, is_cross, score`` of the positives in a split, with a hash as a model's score."""
    receivers = F.transform("external_calls", lambda c: F.nullif(text.call_receiver(c), F.lit("")))
    cross = rules.leaves_contract(receivers, text.stem(F.trim("file")), F.array().cast("array<string>"))
    h = table(spark, sf, "forge_constructable_hyperedges").select("hyperedge_id", cross.alias("is_cross")).distinct()
    s = table(spark, sf, "split_items").where("split is not null and label = 1").select("hyperedge_id", F.lower(F.trim("split")).alias("split"))
    score = F.conv(F.substring(F.sha2(F.concat(F.lit("s:"), F.col("hyperedge_id").cast("string")), 256), 1, 6), 16, 10).cast("long")
    return h.join(s, "hyperedge_id").withColumn("score", F.pmod(score, F.lit(1000)) / 1000)


@query(_CROSS + """SELECT split, is_cross, count_if(score >= 0.5) AS caught, count_if(score < 0.5) AS missed,
  CASE split WHEN 'test' THEN 1 WHEN 'val' THEN 2 WHEN 'train' THEN 3 END + CASE WHEN is_cross THEN 0 ELSE 3 END AS priority FROM s GROUP BY 1, 2""")
def f10_review_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Positives caught and missed by review group: cross-contract ones first, test before val before train."""
    return metrics.review_groups(_reviewed(spark, sf), "split", "is_cross", "score", 0.5)


@query("""SELECT hyperedge_id, CASE WHEN hyperedge_id IN (SELECT hyperedge_id FROM forge_hyperedge_examples WHERE len(state_vars_accessed) > 1) THEN 1 ELSE 0 END AS label FROM split_items""")
def f11_labels(spark: SparkSession, sf: str) -> DataFrame:
    """1 for the items that are among the positives (here: examples of several variables), else 0."""
    positives = table(spark, sf, "forge_hyperedge_examples").where("size(state_vars_accessed) > 1").select("hyperedge_id").distinct().withColumn("is_positive", F.lit(True))
    return table(spark, sf, "split_items", "hyperedge_id").join(positives, "hyperedge_id", "left").select("hyperedge_id", rules.label_of(F.col("is_positive")).alias("label"))


@query("""WITH c AS (SELECT lower(trim(split)) AS split, count(*) AS n, count_if(source = 'forge_main') AS k FROM split_items WHERE split IS NOT NULL GROUP BY 1)
SELECT split, round(coalesce(k * 100.0 / nullif(n, 0), 0), 2) AS pct FROM c""")
def f12_percent(spark: SparkSession, sf: str) -> DataFrame:
    """the share of one collection in each split, in percent to two places."""
    s = table(spark, sf, "split_items").where("split is not null").groupBy(F.lower(F.trim("split")).alias("split"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "forge_main").alias("k")).select("split", text.percent(F.col("k"), F.col("n")).alias("pct"))
