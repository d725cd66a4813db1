"""Aggregates, sampling, gates and split search."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import aggregates, dedup
from weftline.operators import sampling as ops
from weftline.plans.registry import query, table


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def d01_count_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """A1."""
    return aggregates.count_by(table(spark, sf, "orders", "o_custkey"), "o_custkey")


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def d01_most_common(spark: SparkSession, sf: str) -> DataFrame:
    """A2: the twenty most frequent parts."""
    return aggregates.most_common(table(spark, sf, "lineitem", "l_partkey"), "l_partkey", 20)


@query("""SELECT l_returnflag, count_if(l_linestatus = 'F') AS F, count_if(l_linestatus = 'O') AS O FROM lineitem GROUP BY 1""")
def d02_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A7."""
    return aggregates.matrix(table(spark, sf, "lineitem", "l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("""WITH s AS (SELECT lower(trim(split)) AS split, source FROM split_items WHERE split IS NOT NULL)
SELECT split, source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY split), 4) AS pct FROM s GROUP BY 1, 2""")
def d02_split_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and shares by split and source; empty cells do not appear."""
    s = table(spark, sf, "split_items").where("split is not null").select(F.lower(F.trim("split")).alias("split"), "source")
    cells = aggregates.count_by(s, "split", "source")
    total = cells.groupBy("split").agg(F.sum("n").alias("total"))
    return cells.join(total, "split").select("split", "source", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("pct"))


@query("""SELECT source, count(n_chars) AS n, CAST(min(n_chars) AS DOUBLE) AS least, CAST(max(n_chars) AS DOUBLE) AS greatest, median(n_chars) AS middle,
  round(avg(n_chars), 6) AS mean, round(avg(CASE WHEN n_chars > 256 THEN 1.0 WHEN n_chars IS NOT NULL THEN 0.0 END), 6) AS share_above FROM documents GROUP BY 1""")
def d03_spread(spark: SparkSession, sf: str) -> DataFrame:
    """A8, A9."""
    out = aggregates.spread(table(spark, sf, "documents", "source", "n_chars"), ["source"], "n_chars", 256)
    return out.withColumns({"mean": F.round("mean", 6), "share_above": F.round("share_above", 6)})


@query("""SELECT finding_id, round(avg(1 + len(state_vars_accessed) + len(external_calls)), 6) AS avg_nodes, round(avg(len(external_calls)), 6) AS avg_calls
FROM forge_constructable_hyperedges GROUP BY 1""")
def d04_profile(spark: SparkSession, sf: str) -> DataFrame:
    """A5: mean nodes and calls of the hyperedges by finding number."""
    nodes = F.lit(1) + F.size("state_vars_accessed") + F.size("external_calls")
    return table(spark, sf, "forge_constructable_hyperedges").groupBy("finding_id").agg(
        F.round(F.avg(nodes), 6).alias("avg_nodes"), F.round(F.avg(F.size("external_calls")), 6).alias("avg_calls")
    )


@query("SELECT round(count_if(abusive = 0) / count_if(abusive = 1), 6) AS weight FROM abuse_labels")
def d05_class_weight(spark: SparkSession, sf: str) -> DataFrame:
    """A20."""
    return aggregates.class_weight(table(spark, sf, "abuse_labels"), "abusive").select(F.round("weight", 6).alias("weight"))


@query("""SELECT c_custkey FROM customer ORDER BY sha256('42:' || c_custkey), c_custkey LIMIT 100""")
def e01_seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """O3, O5."""
    return ops.seeded_sample(table(spark, sf, "customer", "c_custkey"), "c_custkey", 100)


@query("""WITH t AS (SELECT c_custkey, c_mktsegment, sha256('42:' || c_custkey) AS o FROM customer)
SELECT c_mktsegment, c_custkey FROM t QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY o, c_custkey) <= 20""")
def e02_class_quota(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty of each segment."""
    df = table(spark, sf, "customer", "c_custkey", "c_mktsegment").withColumn("o", ops.seeded(F.col("c_custkey")))
    return ops.first_by_group(df, "c_mktsegment", ["o", "c_custkey"], F.lit(20)).select("c_mktsegment", "c_custkey")


@query("""WITH p AS (SELECT count(*) AS p, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS r FROM orders WHERE o_orderpriority = '1-URGENT'),
h AS (SELECT count_if(o_orderstatus = 'F') AS t, count_if(o_orderstatus <> 'F') AS f FROM orders WHERE o_orderpriority <> '1-URGENT'),
q AS (SELECT least(p * 3, CAST(trunc(least(t / r, f / (1 - r))) AS BIGINT)) AS total, r, t, f FROM p, h)
SELECT least(t, CAST(trunc(total * r) AS BIGINT)) AS n_true, least(f, total - least(t, CAST(trunc(total * r) AS BIGINT))) AS n_false FROM q""")
def e03_balanced_quota(spark: SparkSession, sf: str) -> DataFrame:
    """How many finished and other orders to draw at the ratio of the urgent ones."""
    o = table(spark, sf, "orders", "o_orderpriority", "o_orderstatus").withColumn("done", F.col("o_orderstatus") == "F")
    return ops.balanced_quota(o.where("o_orderpriority <> '1-URGENT'"), o.where("o_orderpriority = '1-URGENT'"), "done")


@query("""WITH t AS (SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN 'A' WHEN s_acctbal > 0 THEN 'B' ELSE 'OZ' END AS tier, s_nationkey % 2 = 0 AS even FROM supplier)
SELECT s_suppkey, tier FROM t QUALIFY row_number() OVER (PARTITION BY even ORDER BY tier, sha256('42:' || s_suppkey), s_suppkey) <= 15""")
def e04_priority_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Fifteen of each kind, tier A before B before OZ."""
    bal = F.col("s_acctbal")
    s = table(spark, sf, "supplier").select(
        "s_suppkey", F.when(bal > 5000, "A").when(bal > 0, "B").otherwise("OZ").alias("tier"),
        (F.col("s_nationkey") % 2 == 0).alias("even"), ops.seeded(F.col("s_suppkey")).alias("o"),
    )
    return ops.first_by_group(s, "even", ["tier", "o", "s_suppkey"], F.lit(15)).select("s_suppkey", "tier")


@query("""WITH pool AS (SELECT o_orderkey, o_orderstatus = 'F' AS done FROM orders WHERE o_orderpriority = '5-LOW'),
ref AS (SELECT o_orderstatus = 'F' AS done FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey FROM pool WHERE abs((SELECT avg(done::INT) FROM pool) - (SELECT avg(done::INT) FROM ref)) <= 0.25""")
def e05_ratio_gate(spark: SparkSession, sf: str) -> DataFrame:
    """O8."""
    o = table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").withColumn("done", F.col("o_orderstatus") == "F")
    return ops.ratio_gate(o.where("o_orderpriority = '5-LOW'"), o.where("o_orderpriority = '1-URGENT'"), "done").select("o_orderkey")


_SEARCH = """
WITH g AS (SELECT o_custkey AS grp, count_if(o_orderstatus = 'F') AS pos, count_if(o_orderstatus <> 'F') AS neg FROM orders GROUP BY 1),
d AS (SELECT run, pos, neg, ('0x' || left(sha256(run || ':' || grp), 8))::BIGINT / 4294967296.0 AS u FROM g, (SELECT unnest(range(1, 201)) AS run)),
s AS (SELECT run, pos, neg, CASE WHEN u < 0.7 THEN 0 WHEN u < 0.85 THEN 1 ELSE 2 END AS s FROM d),
t AS (SELECT run, sum(pos) AS p, sum(neg) AS n,
  sum(CASE WHEN s = 0 THEN pos ELSE 0 END) AS p0, sum(CASE WHEN s = 1 THEN pos ELSE 0 END) AS p1, sum(CASE WHEN s = 2 THEN pos ELSE 0 END) AS p2,
  sum(CASE WHEN s = 0 THEN neg ELSE 0 END) AS n0, sum(CASE WHEN s = 1 THEN neg ELSE 0 END) AS n1, sum(CASE WHEN s = 2 THEN neg ELSE 0 END) AS n2 FROM s GROUP BY 1),
v AS (SELECT run, p0 + n0 AS n0, p1 + n1 AS n1, p2 + n2 AS n2,
  round(abs(p0 / p - 0.7) + abs(n0 / n - 0.7) + abs(p1 / p - 0.15) + abs(n1 / n - 0.15) + abs(p2 / p - 0.15) + abs(n2 / n - 0.15), 9) AS score
  FROM t WHERE abs(p0 / p - 0.7) <= 0.05 AND abs(p1 / p - 0.15) <= 0.05 AND abs(p2 / p - 0.15) <= 0.05)
"""


def _searched(spark: SparkSession, sf: str) -> DataFrame:
    groups = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("pos"), F.count_if(F.col("o_orderstatus") != "F").alias("neg")
    )
    return ops.split_search(groups, 200)


@query(_SEARCH + "SELECT run, n0, n1, n2, score FROM v")
def e06_split_search(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with all their orders, 200 runs."""
    return _searched(spark, sf)


@query(_SEARCH + "SELECT run, score FROM (SELECT *, row_number() OVER (ORDER BY score, run) AS r, count(*) OVER () AS c FROM v) WHERE r = least(6, c)")
def e07_chosen_run(spark: SparkSession, sf: str) -> DataFrame:
    """O2."""
    return ops.pick_run(_searched(spark, sf)).select("run", "score")


@query("""SELECT vfp_id, count(DISTINCT lower(trim(split))) AS n_values FROM (SELECT DISTINCT hyperedge_id, vfp_id FROM forge_constructable_hyperedges WHERE vfp_id IS NOT NULL)
JOIN split_items USING (hyperedge_id) GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1""")
def e08_leakage_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles that the given split tears apart."""
    h = table(spark, sf, "forge_constructable_hyperedges", "hyperedge_id", "vfp_id").distinct()
    s = table(spark, sf, "split_items").select("hyperedge_id", F.lower(F.trim("split")).alias("split"))
    return aggregates.spanning_keys(h.join(s, "hyperedge_id"), "vfp_id", "split")


@query("""SELECT 'customer' AS pool, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'supplier', s_name, s_nationkey, NULL FROM supplier""")
def e09_union_pools(spark: SparkSession, sf: str) -> DataFrame:
    """U1."""
    c = table(spark, sf, "customer").select(F.lit("customer").alias("pool"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("pool"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return ops.union_pools(c, s)


_M = r"list_sort(list_distinct(list_transform({c}, lambda x: regexp_extract(x, '\.(\w+)\s*(?:\{{[^}}]*\}})?\s*\(', 1))))"


@query(rf"""WITH h AS (SELECT DISTINCT hyperedge_id, state_vars_accessed AS sv, external_calls AS ec FROM forge_constructable_hyperedges)
SELECT example_id, list_sort(list_distinct(e.state_vars_accessed)) = list_sort(list_distinct(h.sv)) AS state_vars_match,
  {_M.format(c="e.external_calls")} = {_M.format(c="h.ec")} AS ext_calls_match,
  coalesce(len(list_filter(e.external_calls, lambda x: regexp_extract(x, '^\s*([A-Za-z_$][\w$]*)', 1) NOT IN ('', 'this'))) > 0, false)
  = coalesce(len(list_filter(h.ec, lambda x: regexp_extract(x, '^\s*([A-Za-z_$][\w$]*)', 1) NOT IN ('', 'this'))) > 0, false) AS cc_match,
  len(e.state_vars_accessed) > 0 AND len(e.external_calls) > 0 AS hyperedge_constructable
FROM forge_hyperedge_examples e JOIN h USING (hyperedge_id)""")
def e10_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an example agrees with its hyperedge in variables, methods called and going abroad, and is whole."""
    e = table(spark, sf, "forge_hyperedge_examples").select("example_id", "hyperedge_id", F.col("state_vars_accessed").alias("v"), F.col("external_calls").alias("c"))
    h = table(spark, sf, "forge_constructable_hyperedges").select("hyperedge_id", F.col("state_vars_accessed").alias("v2"), F.col("external_calls").alias("c2")).distinct()
    methods = lambda c: F.transform(c, text.call_method)
    receivers = lambda c: F.transform(c, lambda x: F.nullif(text.call_receiver(x), F.lit("")))
    none = F.array().cast("array<string>")
    leaves = lambda c: rules.leaves_contract(receivers(c), F.lit(""), none)
    return e.join(h, "hyperedge_id").select(
        "example_id", dedup.same_set(F.col("v"), F.col("v2")).alias("state_vars_match"), dedup.same_set(methods("c"), methods("c2")).alias("ext_calls_match"),
        (leaves("c") == leaves("c2")).alias("cc_match"), ((F.size("v") > 0) & (F.size("c") > 0)).alias("hyperedge_constructable"),
    )


@query("SELECT p_partkey, 'X' || substr(p_name, 2, length(p_name) - 4) || 'Y' || right(p_name, 1) AS edited FROM part WHERE length(p_name) > 4")
def e12_edits(spark: SparkSession, sf: str) -> DataFrame:
    """The first letter, and the two before the last, replaced at once."""
    n = F.length("p_name")
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("stop"), F.lit("X").alias("new")), F.struct((n - 3).alias("start"), (n - 1).alias("stop"), F.lit("Y").alias("new")))
    return table(spark, sf, "part", "p_partkey", "p_name").where(n > 4).select("p_partkey", text.apply_edits(F.col("p_name"), edits).alias("edited"))


# Groups of the search below: customers of one nation, with counts of orders. The hard ranges are fifteen
# hundredths around the wanted shares of all orders, finished or not, and of urgent finished ones in two splits.
_RANGED = [("pos", 0, 0.7), ("pos", 1, 0.15), ("pos", 2, 0.15), ("neg", 0, 0.7), ("neg", 1, 0.15), ("neg", 2, 0.15), ("extra", 1, 0.15), ("extra", 2, 0.15)]
_TYPES = [("t1", 0.2), ("t2", 0.2), ("t3", 0.2), ("t4", 0.2)]
_SUMS = ", ".join(f"sum(CASE WHEN s = {i} THEN {c} ELSE 0 END) AS {c}{i}" for c in ("pos", "neg", "extra", "pcross", "ncross", "t1", "t2", "t3", "t4") for i in range(3))
_HELD = " AND ".join(f"{c}{i} BETWEEN floor({w} * a{c} * 0.85) AND ceil({w} * a{c} * 1.15)" for c, i, w in _RANGED)
_OFF = " + ".join(
    [f"abs(coalesce(pcross{i} / nullif(pos{i}, 0), 0) - 0.5) + abs(coalesce(ncross{i} / nullif(neg{i}, 0), 0) - 0.5)" for i in range(3)]
    + [f"abs(coalesce({t}{i} / nullif(pos{i}, 0), 0) - {w})" for t, w in _TYPES for i in range(3)]
)


@query(f"""WITH o AS (SELECT c_nationkey AS grp, o_orderstatus = 'F' AS done, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT grp, count_if(done) AS pos, count_if(NOT done) AS neg, count_if(done AND p = '1-URGENT') AS extra, count_if(done AND p IN ('1-URGENT', '2-HIGH')) AS pcross,
  count_if(NOT done AND p IN ('1-URGENT', '2-HIGH')) AS ncross, count_if(done AND p = '1-URGENT') AS t1, count_if(done AND p = '2-HIGH') AS t2, count_if(done AND p = '3-MEDIUM') AS t3,
  count_if(done AND p = '5-LOW') AS t4 FROM o GROUP BY 1),
a AS (SELECT sum(pos) AS apos, sum(neg) AS aneg, sum(extra) AS aextra FROM g),
d AS (SELECT *, ('0x' || left(sha256(run || ':' || grp), 8))::BIGINT / 4294967296.0 AS u FROM g, (SELECT unnest(range(1, 20001)) AS run)),
s AS (SELECT *, CASE WHEN u < 0.7 THEN 0 WHEN u < 0.85 THEN 1 ELSE 2 END AS s FROM d), t AS (SELECT run, {_SUMS} FROM s GROUP BY 1)
SELECT run, {", ".join(f"{c}{i}" for c, i, _ in _RANGED)}, round({_OFF}, 9) AS score FROM t, a WHERE {_HELD}""")
def e11_constrained_search(spark: SparkSession, sf: str) -> DataFrame:
    """20,000 draws of nations with all their orders, eight hard ranges, scored by ratios in every split."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("grp"), (F.col("o_orderstatus") == "F").alias("done"), F.col("o_orderpriority").alias("p")
    )
    done, top = F.col("done"), F.col("p").isin("1-URGENT", "2-HIGH")
    groups = aggregates.conditional_counts(o, ["grp"], {
        "pos": done, "neg": ~done, "extra": done & (F.col("p") == "1-URGENT"), "pcross": done & top, "ncross": ~done & top,
        "t1": done & (F.col("p") == "1-URGENT"), "t2": done & (F.col("p") == "2-HIGH"), "t3": done & (F.col("p") == "3-MEDIUM"), "t4": done & (F.col("p") == "5-LOW"),
    }).drop("n")
    whole = groups.agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "extra")]).first()
    ranges = {(c, i): (math.floor(w * (whole[c] or 0) * 0.85), math.ceil(w * (whole[c] or 0) * 1.15)) for c, i, w in _RANGED}
    wanted = [("pcross", "pos", 0.5), ("ncross", "neg", 0.5), *((t, "pos", w) for t, w in _TYPES)]
    return ops.constrained_search(groups, 20_000, ranges, wanted)
