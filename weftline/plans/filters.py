"""Filters, classifiers and projections over findings and hyperedges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import aggregates
from weftline.plans.registry import query, table

# The SQL has its own statement of the fixed values, so that a slip in the rules shows.
_CWES = ", ".join(f"'CWE-{n}'" for n in (
    362, 364, 366, 367, 421, 435, 436, 437, 439, 662, 663, 667, 670, 674, 691, 696, 764, 765, 820, 821, 834, 835, 841, 1058, 1088, 1265,
))
_KEYWORDS = r"re-?entrancy|re-?entrant|flash[\s-]?loan|front[\s-]?run|sandwich|cross[\s-]?contract|callback"
_FLAGS = rf"""
WITH f AS (
  SELECT vfp_id, finding_id, title,
         coalesce(list_has_any(flatten(map_values(category)), [{_CWES}]), false) AS by_cwe,
         regexp_matches(coalesce(title, '') || ' ' || coalesce(description, ''), '{_KEYWORDS}', 'i') AS by_keyword
  FROM forge_findings
)"""


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "forge_findings").select(
        "vfp_id", "finding_id", "title", "description", "severity", "category", "location",
        rules.has_interaction_cwe(F.col("category")).alias("by_cwe"),
        rules.has_interaction_keyword(F.col("title"), F.col("description")).alias("by_keyword"),
    )


@query(_FLAGS + " SELECT vfp_id, finding_id, title FROM f WHERE by_cwe OR by_keyword")
def a01_interaction_filter(spark: SparkSession, sf: str) -> DataFrame:
    """P1-P3."""
    return _flagged(spark, sf).where("by_cwe or by_keyword").select("vfp_id", "finding_id", "title")


@query(_FLAGS + """ SELECT CASE WHEN by_cwe AND by_keyword THEN 'both' WHEN by_cwe THEN 'cwe-only'
WHEN by_keyword THEN 'keyword-only' END AS match_type, count(*) AS n FROM f GROUP BY 1""")
def a02_match_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """P4; findings that match in no way count under null."""
    kind = rules.match_type(F.col("by_cwe"), F.col("by_keyword")).alias("match_type")
    return aggregates.count_by(_flagged(spark, sf).select(kind), "match_type")


@query(rf"""SELECT pattern, count_if(regexp_matches(coalesce(title, '') || ' ' || coalesce(description, ''), pattern, 'i')) AS n
FROM forge_findings, (SELECT unnest(['re-?entrancy', 're-?entrant', 'flash[\s-]?loan', 'front[\s-]?run(?:ning)?', 'sandwich', 'cross[\s-]?contract', 'callback',
  'read[\s-]?only[\s-]?re-?entrancy', 'reentrancy']) AS pattern) GROUP BY 1""")
def a03_matched_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """P5: findings by keyword pattern."""
    df = table(spark, sf, "forge_findings", "title", "description")
    return aggregates.matched_terms(df, rules.finding_text(F.col("title"), F.col("description")), rules.INTERACTION_KEYWORDS)


@query(rf"""SELECT cwe, count(*) AS n FROM (
  SELECT unnest(list_distinct(flatten(map_values(category)))) AS cwe FROM forge_findings) WHERE cwe IN ({_CWES}) GROUP BY 1""")
def a03_matched_cwes(spark: SparkSession, sf: str) -> DataFrame:
    """P5: findings by interaction weakness."""
    hit = F.array_intersect(rules.category_codes(F.col("category")), F.array(*map(F.lit, rules.INTERACTION_CWES)))
    return aggregates.count_by(table(spark, sf, "forge_findings").select(F.explode(hit).alias("cwe")), "cwe")


@query(r"""WITH l AS (SELECT vfp_id, finding_id, unnest(location) AS loc FROM forge_findings)
SELECT vfp_id, finding_id, trim(split_part(split_part(loc, '#', 1), '::', 1)) AS file,
  CASE WHEN contains(split_part(loc, '#', 1), '::') THEN trim(split_part(split_part(loc, '#', 1), '::', 2)) END AS "function",
  CASE WHEN contains(loc, '#') THEN trim(regexp_extract(loc, '#(.*)$', 1)) END AS lines
FROM l WHERE contains(loc, '::')""")
def a04_location_parse(spark: SparkSession, sf: str) -> DataFrame:
    """P6, D3, F7."""
    loc = F.filter("location", lambda x: x.contains("::"))
    return table(spark, sf, "forge_findings").select("vfp_id", "finding_id", F.explode(loc).alias("loc")).select(
        "vfp_id", "finding_id", text.parse_location(F.col("loc")).alias("p")
    ).select("vfp_id", "finding_id", "p.*")


@query(r"""WITH p AS (SELECT p_partkey, p_type || '-' || p_brand || '-' || p_size AS category FROM part)
SELECT p_partkey, array_to_string(list_slice(string_split(category, '-'), 1, 2), '-') AS code FROM p""")
def a05_code_derive(spark: SparkSession, sf: str) -> DataFrame:
    """P7."""
    category = F.concat_ws("-", "p_type", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.code_of(category).alias("code"))


@query(r"""SELECT hyperedge_id, CASE WHEN contains(coalesce(vtype, ''), '104') THEN 'SWC-104' WHEN contains(coalesce(vtype, ''), '107') THEN 'SWC-107'
  WHEN contains(coalesce(vtype, ''), '114') THEN 'SWC-114' WHEN contains(coalesce(vtype, ''), '112') THEN 'SWC-112' ELSE '' END AS swc
FROM split_items WHERE regexp_matches(coalesce(vtype, ''), '10[47]|11[24]')""")
def a05_code_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Code from the type, only interaction codes."""
    code = rules.swc_of(F.lit(None).cast("string"), F.col("vtype"), F.lit(None).cast("string"))
    return table(spark, sf, "split_items").select("hyperedge_id", code.alias("swc")).where(F.col("swc").isin(rules.INTERACTION_SWCS))


_VTYPE = """CASE WHEN regexp_matches(t, 'reentrancy|re-entrancy|reentrant|callback') THEN 'Reentrancy (SWC-107)'
  WHEN regexp_matches(t, 'unchecked|call return') THEN 'Unchecked Call Return (SWC-104)'
  WHEN regexp_matches(t, 'front-run|frontrun|sandwich|transaction order') THEN 'Front-running / Tx Order (SWC-114)'
  WHEN contains(t, 'delegatecall') THEN 'Delegatecall (SWC-112)' ELSE 'Reentrancy (SWC-107)' END"""


@query(f"""SELECT vtype, count(*) AS n FROM (SELECT {_VTYPE} AS vtype FROM (
  SELECT lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS t FROM forge_findings)) GROUP BY 1""")
def a06_vulnerability_types(spark: SparkSession, sf: str) -> DataFrame:
    """P18, P19, A1."""
    df = table(spark, sf, "forge_findings", "title", "description")
    return aggregates.count_by(df.select(rules.vulnerability_type(F.col("title"), F.col("description")).alias("vtype")), "vtype")


@query("""SELECT doc_id, coalesce(nullif(vfp_id, ''), nullif(source, ''), 'eval_item') AS source_id,
  CASE WHEN source LIKE '%mirror%' OR source LIKE '%archive%' THEN 'collected' WHEN vfp_id IS NOT NULL THEN 'bundle' ELSE 'other' END AS origin,
  coalesce(nullif(trim(lang), ''), 'unknown') AS lang FROM documents""")
def a07_default_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Default filling and inference of where a row is from."""
    source = F.col("source")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.coalesce(F.nullif("vfp_id", F.lit("")), F.nullif("source", F.lit("")), F.lit("eval_item")).alias("source_id"),
        F.when(source.contains("mirror") | source.contains("archive"), "collected")
        .when(F.col("vfp_id").isNotNull(), "bundle").otherwise("other").alias("origin"),
        F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("unknown")).alias("lang"),
    )


@query("""SELECT position, stage, n FROM (SELECT
  count(*) AS c0, count_if(len(state_vars_accessed) > 0) AS c1,
  count_if(len(state_vars_accessed) > 0 AND len(external_calls) > 0) AS c2,
  count_if(len(state_vars_accessed) > 0 AND len(external_calls) > 0 AND function IS NOT NULL) AS c3 FROM forge_constructable_hyperedges),
LATERAL (SELECT unnest([0, 1, 2, 3]) AS position, unnest(['all', 'state', 'constructable', 'named']) AS stage, unnest([c0, c1, c2, c3]) AS n)""")
def a08_constructable_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """P12, P13."""
    df = table(spark, sf, "forge_constructable_hyperedges", "state_vars_accessed", "external_calls", "function")
    return aggregates.funnel(df, {
        "all": F.lit(True), "state": F.size("state_vars_accessed") > 0,
        "constructable": F.size("external_calls") > 0, "named": F.col("function").isNotNull(),
    })


@query(r"""SELECT example_id, left(function_source, 500) AS head, left(external_calls[1], 120) AS first_call,
  list_slice(state_vars_accessed, 1, 10) AS some_vars,
  CASE WHEN len(string_split(function_source, E'\n')) > 40 THEN array_to_string(
    list_concat(list_concat(list_slice(string_split(function_source, E'\n'), 1, 20), ['...']),
      list_slice(string_split(function_source, E'\n'), -10, -1)), E'\n') ELSE function_source END AS shown
FROM forge_hyperedge_examples""")
def a09_truncations(spark: SparkSession, sf: str) -> DataFrame:
    """P14-P16."""
    return table(spark, sf, "forge_hyperedge_examples").select(
        "example_id", F.left("function_source", F.lit(500)).alias("head"),
        F.left(F.get("external_calls", F.lit(0)), F.lit(120)).alias("first_call"),
        F.slice("state_vars_accessed", 1, 10).alias("some_vars"),
        text.elided(F.col("function_source"), 40, 20, 10).alias("shown"),
    )


@query(r"""WITH l AS (SELECT vfp_id, finding_id, unnest(location) AS loc FROM forge_findings),
r AS (SELECT vfp_id, finding_id, loc, regexp_replace(regexp_extract(loc, '#(.*)$', 1), '[Ll\s]', '', 'g') AS b FROM l)
SELECT vfp_id, finding_id, loc,
  CASE WHEN regexp_matches(b, '^\d+(-\d+.*)?$') THEN CAST(regexp_extract(b, '^(\d+)', 1) AS INTEGER) ELSE 0 END AS start,
  CASE WHEN regexp_matches(b, '^\d+(-\d+.*)?$') THEN coalesce(try_cast(nullif(regexp_extract(b, '^\d+-(\d+)', 1), '') AS INTEGER), CAST(regexp_extract(b, '^(\d+)', 1) AS INTEGER)) ELSE 999999 END AS stop
FROM r""")
def a10_line_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """C18 over all locations; one without lines spans the whole file."""
    df = table(spark, sf, "forge_findings").select("vfp_id", "finding_id", F.explode("location").alias("loc"))
    return df.select("vfp_id", "finding_id", "loc", text.parse_line_range(F.regexp_extract("loc", r"#(.*)\z", 1)).alias("r")).select(
        "vfp_id", "finding_id", "loc", "r.start", "r.stop"
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def a11_json_extract(spark: SparkSession, sf: str) -> DataFrame:
    """A field of a JSON column."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(r"""SELECT hyperedge_id, trim(coalesce(severity, '') || ' ' || coalesce(function, '')) AS typed,
  list_last(string_split(file, '/')) AS base, regexp_replace(list_last(string_split(file, '/')), '\.[^.]*$', '') AS stem,
  regexp_replace(function, '[\[\]]+$', '') AS bare FROM forge_constructable_hyperedges""")
def a12_names(spark: SparkSession, sf: str) -> DataFrame:
    """F6-F8."""
    return table(spark, sf, "forge_constructable_hyperedges").select(
        "hyperedge_id", text.typed_name(F.col("severity"), F.col("function")).alias("typed"),
        text.basename(F.col("file")).alias("base"), text.stem(F.col("file")).alias("stem"),
        text.strip_brackets(F.col("function")).alias("bare"),
    )
