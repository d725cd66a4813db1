"""Recursion and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import aggregates, closure
from weftline.operators.components import connected_components, star_edges
from weftline.plans.keys import HASH, hashed_examples
from weftline.plans.registry import query, table

# The hierarchy of the queries below: part k has the bases k div 10 and k div 7, in this order.
_PATHS = """
WITH RECURSIVE e AS (
  SELECT p_partkey AS node, p_partkey // 10 AS base, 0 AS ord FROM part WHERE p_partkey // 10 > 0
  UNION ALL SELECT p_partkey, p_partkey // 7, 1 FROM part WHERE p_partkey // 7 > 0
), w AS (
  SELECT p_partkey AS node, p_partkey AS anc, CAST([] AS INTEGER[]) AS path, [p_partkey] AS trail FROM part
  UNION ALL SELECT w.node, e.base, list_append(path, e.ord), list_append(trail, e.base) FROM w JOIN e ON w.anc = e.node
  WHERE NOT list_contains(trail, e.base)
), v AS (SELECT node, anc, min(path) AS path FROM w GROUP BY 1, 2),
m AS (SELECT p_partkey AS anc, 'v' || (p_partkey % 7) AS name, p_type AS value FROM part)
"""


def _hierarchy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf, "part", "p_partkey", "p_type")
    bases = F.array(
        F.struct(F.expr("p_partkey div 10").alias("base"), F.lit(0).alias("ord")),
        F.struct(F.expr("p_partkey div 7").alias("base"), F.lit(1).alias("ord")),
    )
    edges = part.select(F.col("p_partkey").alias("node"), F.inline(bases)).where("base > 0")
    members = part.select(
        F.col("p_partkey").alias("node"), F.concat(F.lit("v"), F.col("p_partkey") % 7).alias("name"), F.col("p_type").alias("value")
    )
    return closure.ancestor_paths(part.select(F.col("p_partkey").alias("node")), edges), members


@query(_PATHS + "SELECT DISTINCT node, name FROM v JOIN m USING (anc)")
def c01_inherited_set(spark: SparkSession, sf: str) -> DataFrame:
    """G1."""
    return closure.inherited_set(*_hierarchy(spark, sf))


@query(_PATHS + "SELECT node, name, arg_min(value, path) AS value FROM v JOIN m USING (anc) GROUP BY 1, 2")
def c02_nearest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """G2."""
    return closure.nearest_wins(*_hierarchy(spark, sf))


@query(_PATHS + "SELECT node, name, arg_min(anc, list_transform(path, lambda x: -x)) AS owner FROM v JOIN m USING (anc) GROUP BY 1, 2")
def c03_last_base_wins(spark: SparkSession, sf: str) -> DataFrame:
    """G3."""
    return closure.last_base_wins(*_hierarchy(spark, sf))


_COMPONENTS = f"""
WITH RECURSIVE h AS (
  SELECT DISTINCT CAST(regexp_extract(vfp_id, '(\\d+)', 1) AS BIGINT) AS b, {HASH.format(c="function_source")} AS hash
  FROM forge_hyperedge_examples WHERE vfp_id IS NOT NULL AND function_source IS NOT NULL
), e AS (SELECT DISTINCT x.b AS a, y.b AS b FROM h x JOIN h y USING (hash)),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
k AS (SELECT a AS node, min(b) AS component FROM c GROUP BY 1)
"""


def _bundle_components(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    h = hashed_examples(spark, sf).where("vfp_id is not null and function_source is not null").select(
        F.regexp_extract("vfp_id", r"(\d+)", 1).try_cast("bigint").alias("b"), "hash", "severity", "hyperedge_id"
    )
    # bundles that share nothing are components of their own: self-loops keep them
    loops = h.select(F.col("b").alias("a"), "b").distinct()
    return connected_components(star_edges(h, "b", "hash").unionByName(loops)), h


@query(_COMPONENTS + "SELECT node, component FROM k")
def c04_components(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles joined by equal sources; every bundle has its least linked one."""
    return _bundle_components(spark, sf)[0]


@query(_COMPONENTS + """SELECT component, count(*) AS n, count(*) FILTER (WHERE lower(trim(severity)) = 'high') AS high, count(*) FILTER (WHERE lower(trim(severity)) = 'medium') AS medium
FROM forge_hyperedge_examples JOIN k ON CAST(regexp_extract(vfp_id, '(\\d+)', 1) AS BIGINT) = node WHERE function_source IS NOT NULL GROUP BY 1""")
def c05_group_features(spark: SparkSession, sf: str) -> DataFrame:
    """A4: rows of each component by severity."""
    components, h = _bundle_components(spark, sf)
    grade = F.lower(F.trim("severity"))
    return aggregates.conditional_counts(
        h.join(components, h["b"] == components["node"]), ["component"], {"high": grade == "high", "medium": grade == "medium"}
    )


@query("""SELECT hyperedge_id, len(list_filter(list_distinct(state_vars_accessed), lambda v: NOT starts_with(v, '_'))) > 0 AS inherited_vars_used,
  len(list_filter(external_calls, lambda c: NOT starts_with(c, '_') AND list_contains(state_vars_accessed, regexp_extract(c, '^\\s*([A-Za-z_$][\\w$]*)', 1)))) > 0 AS inherited_calls_used
FROM forge_constructable_hyperedges""")
def c06_inherited_use(spark: SparkSession, sf: str) -> DataFrame:
    """G4, with the variables that begin with an underscore taken as the contract's own."""
    accessed = F.col("state_vars_accessed")
    own = F.filter(accessed, lambda v: v.startswith("_"))
    receivers = F.transform("external_calls", lambda c: F.regexp_extract(c, r"\A\s*([A-Za-z_$][\w$]*)", 1))
    used, called = closure.inherited_use(accessed, own, receivers, accessed)
    return table(spark, sf, "forge_constructable_hyperedges").select(
        "hyperedge_id", used.alias("inherited_vars_used"), called.alias("inherited_calls_used")
    )


@query("""SELECT array_to_string(list_slice(string_split(file, '/'), 1, 2), '/') AS root, count(*) AS n FROM forge_constructable_hyperedges GROUP BY 1""")
def c07_project_roots(spark: SparkSession, sf: str) -> DataFrame:
    """G6, with the first two parts of a path as its root."""
    root = closure.project_root(F.col("file"), 2).alias("root")
    return aggregates.count_by(table(spark, sf, "forge_constructable_hyperedges").select(root), "root")
