"""Pooling and scoring of vectors (M3-M7)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import metrics, vectors
from weftline.plans.registry import query, table

QUERY = [round(((7 * i) % 11 - 5) / 10, 1) for i in range(64)]


@query(f"""WITH e AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL),
w AS (SELECT label, x, exp(list_dot_product(list_transform(x, lambda y: (exp(2*y) - 1) / (exp(2*y) + 1)), {QUERY}::DOUBLE[])) AS w FROM e),
d AS (SELECT label, w, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS dim FROM w)
SELECT label, dim, round(sum(w * v) / sum(w), 6) AS pooled FROM d GROUP BY 1, 2""")
def g01_attention_pool(spark: SparkSession, sf: str) -> DataFrame:
    """M3: one pooled vector a label, in long form."""
    pooled = vectors.attention_pool(table(spark, sf, "embeddings", "label", "embedding"), "label", "embedding", QUERY)
    return pooled.select("label", F.posexplode("pooled").alias("dim", "v")).select("label", F.col("dim").cast("bigint").alias("dim"), F.round("v", 6).alias("pooled"))


def _parameters(d: int = 64, hidden: int = 16) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(42)
    return {
        "W": np.eye(d), "b": np.zeros(d), "v": np.array(QUERY), "W1": rng.normal(0, d**-0.5, (hidden, d)),
        "b1": np.zeros(hidden), "W2": rng.normal(0, hidden**-0.5, hidden), "b2": np.zeros(()),
    }


def _scoring_sql() -> str:
    p = _parameters()
    rows = lambda w: "[" + ", ".join(str([float(x) for x in r]) for r in w) + "]"
    return f"""WITH e AS (SELECT vec_id // 3 AS item, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE embedding IS NOT NULL),
w AS (SELECT item, x, exp(list_dot_product(list_transform(x, lambda y: (exp(2*y) - 1) / (exp(2*y) + 1)), {QUERY}::DOUBLE[])) AS w FROM e),
d AS (SELECT item, w, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM w),
s AS (SELECT item, dim, sum(w * v) / sum(w) AS v FROM d GROUP BY 1, 2),
l AS (SELECT item, list(v ORDER BY dim)::DOUBLE[] AS pooled FROM s GROUP BY 1),
h AS (SELECT item, list_transform({rows(p["W1"])}::DOUBLE[][], lambda r: greatest(list_dot_product(r, pooled), 0)) AS hidden FROM l)
SELECT item, round(1 / (1 + exp(-list_dot_product(hidden, {[float(x) for x in p["W2"]]}::DOUBLE[]))), 6) AS prob FROM h"""


@query(_scoring_sql())
def g02_pool_and_score(spark: SparkSession, sf: str) -> DataFrame:
    """M4, M5, M7: ragged groups of vectors pooled and scored by a two-layer head."""
    return _scored_items(spark, sf, _parameters()).withColumn("prob", F.round("prob", 6))


def _scored_items(spark: SparkSession, sf: str, parameters: dict[str, np.ndarray]) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.expr("vec_id div 3").alias("item"), "vec_id", "embedding").where("embedding is not null")
    # three vectors an item, of the fixed number that an id gives
    grouped = rows.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    return vectors.pool_and_score(grouped.select("item", F.transform("v", lambda x: x["embedding"]).alias("v")), "item", "v", parameters)


#: Rows that the head is trained on at most, chosen by hash; all are scored.
TRAINED_ON = 20_000


@query("""SELECT count(*) AS n_scored, count_if(label >= 5) AS n_pos, true AS kept_recall, true AS in_range FROM embeddings WHERE embedding IS NOT NULL""")
def g03_train_and_score(spark: SparkSession, sf: str) -> DataFrame:
    """M6-M8: a head trained on a bounded sample of vectors, all rows scored, the threshold that keeps 0.95 of the
    positives, and whether it does. A label of five or more stands for a positive."""
    rows = table(spark, sf, "embeddings").where("embedding is not null").withColumn("y", (F.col("label") >= 5).cast("int"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRAINED_ON).select("embedding", "y").toPandas()
    head = _parameters() | {"v": np.zeros(64)}
    if len(sample):
        head |= vectors.train_head(np.stack(sample["embedding"].to_list()).astype(float), sample["y"].fillna(0).to_numpy(), epochs=60)
    scored = vectors.pool_and_score(rows.withColumn("v", F.array("embedding")), "vec_id", "v", head).join(rows.select("vec_id", "y"), "vec_id")
    found = metrics.threshold_at_recall(scored, "y", "prob")
    counts = scored.agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(F.col("y") == 1).alias("n_pos"), F.min(F.col("prob").between(0, 1)).alias("in_range"))
    return counts.crossJoin(found.select((F.col("recall_at") >= 0.95).alias("kept_recall")))
