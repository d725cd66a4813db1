"""Deduplication, joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, text
from weftline.operators import dedup, joins
from weftline.operators.vectors import counting_encoder
from weftline.plans.registry import query, table

NORMAL = r"lower(regexp_replace(regexp_replace(regexp_replace({c}, '/\*.*?\*/', '', 'gs'), '//[^\n]*', '', 'g'), '[\s\x0b\x{{85}}\p{{Z}}]+', '', 'g'))"
HASH = "sha256(" + NORMAL + ")"
_DOC_HASH, _SRC_HASH = HASH.format(c="text"), HASH.format(c="function_source")


def hashed_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").withColumn("hash", text.source_hash(F.col("text")))


def hashed_examples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "forge_hyperedge_examples").withColumn("hash", text.source_hash(F.col("function_source")))


@query(f"""WITH h AS (SELECT doc_id, source, {_DOC_HASH} AS hash FROM documents),
d AS (SELECT source FROM h QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1)
SELECT source, count(*) AS n_unique FROM d GROUP BY 1""")
def b01_hash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after deduplication by normalised hash, by source; null texts are one."""
    unique = dedup.first_wins(hashed_documents(spark, sf).select("hash", "doc_id", "source"), ["hash"], ["doc_id"])
    return unique.groupBy("source").agg(F.count("*").alias("n_unique"))


@query(f"""WITH h AS (SELECT source, {_DOC_HASH} AS hash FROM documents WHERE text IS NOT NULL)
SELECT hash, count(DISTINCT source) AS n_groups, count(*) AS n_rows FROM h GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def b02_cross_source_dups(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A10."""
    return dedup.shared_keys(hashed_documents(spark, sf).select("hash", "source"), "hash", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM abuse_labels WHERE abusive = 0)")
def b03_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """J7."""
    labels = table(spark, sf, "abuse_labels").where("abusive = 0")
    return dedup.in_other(table(spark, sf, "documents", "doc_id", "source"), labels, ["doc_id"], True)


@query(f"""WITH h AS (SELECT example_id, {_SRC_HASH} AS hash, hyperedge_id FROM forge_hyperedge_examples WHERE function_source IS NOT NULL),
t AS (SELECT hash FROM h JOIN split_items USING (hyperedge_id) WHERE lower(trim(split)) = 'train')
SELECT example_id FROM h WHERE hash NOT IN (SELECT hash FROM t)""")
def b04_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Examples whose source stands in no training row."""
    h = hashed_examples(spark, sf).where("function_source is not null").select("example_id", "hash", "hyperedge_id")
    train = h.join(table(spark, sf, "split_items").where("lower(trim(split)) = 'train'"), "hyperedge_id")
    return dedup.in_other(h, train, ["hash"], False).select("example_id")


@query(r"""WITH f AS (SELECT DISTINCT vfp_id, unnest(files) AS cand FROM forge_findings),
l AS (SELECT DISTINCT vfp_id, split_part(split_part(loc, '#', 1), '::', 1) AS file FROM (SELECT vfp_id, unnest(location) AS loc FROM forge_findings)),
c AS (SELECT l.vfp_id, l.file, cand, CASE WHEN cand = file THEN 0 WHEN ends_with(cand, file) OR ends_with(file, cand) THEN 1 END AS p
  FROM l LEFT JOIN f ON l.vfp_id = f.vfp_id)
SELECT vfp_id, file, min(CASE WHEN p IS NOT NULL THEN p || ':' || cand END)[3:] AS cand FROM c GROUP BY 1, 2""")
def b05_priority_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each located file's source in its bundle, exact name first, else a suffix."""
    findings = table(spark, sf, "forge_findings")
    located = findings.select("vfp_id", F.explode("location").alias("loc")).select(
        "vfp_id", text.parse_location(F.col("loc"))["file"].alias("file")
    ).distinct().withColumn("row", F.struct("vfp_id", "file"))
    files = findings.select("vfp_id", F.explode("files").alias("cand")).distinct()
    priority = F.when(F.col("cand") == F.col("file"), 0).when(
        F.col("cand").endswith(F.col("file")) | F.col("file").endswith(F.col("cand")), 1
    )
    return joins.best_match(located, files, ["vfp_id"], "row", priority, [], ["cand"]).select("row.vfp_id", "row.file", "cand")


_RANGES = r"""WITH l AS (SELECT vfp_id, finding_id, unnest(location) AS loc FROM forge_findings),
r AS (SELECT DISTINCT vfp_id, finding_id, split_part(split_part(loc, '#', 1), '::', 1) AS file, loc,
  CAST(regexp_extract(loc, '#L(\d+)', 1) AS INTEGER) AS s, CAST(coalesce(nullif(regexp_extract(loc, '-L(\d+)$', 1), ''), regexp_extract(loc, '#L(\d+)', 1)) AS INTEGER) AS e
  FROM l WHERE contains(loc, '#'))"""


def _ranges(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "forge_findings").select("vfp_id", "finding_id", F.explode("location").alias("loc")).where("loc like '%#%'")
    p = text.parse_location(F.col("loc"))
    r = text.parse_line_range(p["lines"])
    return df.select("vfp_id", "finding_id", p["file"].alias("file"), "loc", r["start"].alias("s"), r["stop"].alias("e")).distinct()


@query(_RANGES + """ SELECT a.vfp_id, a.file, a.finding_id AS finding_a, b.finding_id AS finding_b, a.loc AS loc_a, b.loc AS loc_b
FROM r a JOIN r b ON a.vfp_id = b.vfp_id AND a.file = b.file AND a.s <= b.e AND b.s <= a.e WHERE a.finding_id < b.finding_id""")
def b06_interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of one bundle whose line ranges in a file meet, joined in blocks of lines."""
    r = _ranges(spark, sf)
    side = lambda x: r.select("vfp_id", "file", *[F.col(c).alias(f"{c}_{x}") for c in ("finding_id", "loc", "s", "e")])
    both = joins.overlapping_in_blocks(side("a"), side("b"), ["vfp_id", "file"], ("s_a", "e_a"), ("s_b", "e_b"), 200)
    return both.where("finding_id_a < finding_id_b").select(
        "vfp_id", "file", F.col("finding_id_a").alias("finding_a"), F.col("finding_id_b").alias("finding_b"), "loc_a", "loc_b"
    )


@query(_RANGES + """, n AS (SELECT *, CASE WHEN contains(split_part(loc, '#', 1), '::') THEN trim(split_part(split_part(loc, '#', 1), '::', 2)) END AS fn FROM r),
o AS (SELECT a.vfp_id, a.loc AS loc, b.loc AS best, b.s, a.fn IS DISTINCT FROM b.fn AS other FROM n a JOIN n b
  ON a.vfp_id = b.vfp_id AND a.file = b.file AND a.s <= b.e AND b.s <= a.e WHERE a.loc <> b.loc AND b.fn IS NOT NULL)
SELECT vfp_id, loc, arg_min(best, (other, s, best)) AS best FROM o GROUP BY 1, 2""")
def b06_best_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Of the ranges that meet a location, that of the same function, else the first in document order;
    ranges in no function are dropped."""
    r = _ranges(spark, sf).select("vfp_id", "file", "loc", "s", "e", text.parse_location(F.col("loc"))["function"].alias("fn")).distinct()
    other = r.where("fn is not null").select("vfp_id", "file", F.col("loc").alias("best"), F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("fn").alias("fn2"))
    met = joins.overlapping_in_blocks(r, other, ["vfp_id", "file"], ("s", "e"), ("s2", "e2"), 200).where("loc <> best")
    return met.groupBy("vfp_id", "loc").agg(F.min(F.struct(~F.col("fn").eqNullSafe(F.col("fn2")), "s2", "best"))["best"].alias("best"))


@query(None)
def b07_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Validation and test examples more than 0.9 similar to a training one of the same file."""
    base = table(spark, sf, "forge_hyperedge_examples").select(
        "example_id", "hyperedge_id", F.lower(text.basename(F.trim("file"))).alias("base"), text.normalize_source(F.col("function_source")).alias("src")
    )
    placed = base.join(table(spark, sf, "split_items").select("hyperedge_id", F.lower(F.trim("split")).alias("split")), "hyperedge_id")
    return joins.near_duplicates_of(
        placed.where("split in ('val', 'test')"), placed.where("split = 'train'"), "example_id", "base", "src"
    )


@query(f"""WITH h AS (SELECT {_SRC_HASH} AS hash, lower(trim(split)) AS split FROM forge_hyperedge_examples JOIN split_items USING (hyperedge_id) WHERE function_source IS NOT NULL)
SELECT split, count(*) AS n_rows, count(DISTINCT hash) AS n_hashes FROM h WHERE split IN ('val', 'test') AND hash IN (SELECT hash FROM h WHERE split = 'train') GROUP BY 1""")
def b08_leakage(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of evaluation splits whose hash stands in training too."""
    h = hashed_examples(spark, sf).where("function_source is not null").join(
        table(spark, sf, "split_items").select("hyperedge_id", F.lower(F.trim("split")).alias("split")), "hyperedge_id"
    ).select("hash", "split")
    leaked = dedup.in_other(h.where("split in ('val', 'test')"), h.where("split = 'train'"), ["hash"], True)
    return leaked.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("hash").alias("n_hashes"))


@query("""SELECT CASE WHEN vfp_id IN (SELECT vfp_id FROM forge_findings WHERE severity = 'Critical') THEN 'A' ELSE 'B' END AS tier, count(*) AS n
FROM documents WHERE vfp_id IS NOT NULL GROUP BY 1""")
def b09_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """J19."""
    docs = table(spark, sf, "documents", "doc_id", "vfp_id").where("vfp_id is not null")
    tiered = joins.tiers(docs, table(spark, sf, "forge_findings").where("severity = 'Critical'").select("vfp_id"), "vfp_id")
    return tiered.groupBy("tier").agg(F.count("*").alias("n"))


@query("""WITH now AS (SELECT DISTINCT vfp_id, finding_id FROM forge_constructable_hyperedges WHERE vfp_id IS NOT NULL AND finding_id IS NOT NULL),
old AS (SELECT DISTINCT vfp_id, finding_id FROM forge_findings)
SELECT CASE WHEN old.vfp_id IS NULL THEN 'new' ELSE 'retained' END AS status, count(*) AS n FROM now LEFT JOIN old USING (vfp_id, finding_id) GROUP BY 1""")
def b10_retained_new(spark: SparkSession, sf: str) -> DataFrame:
    """J16."""
    now = table(spark, sf, "forge_constructable_hyperedges", "vfp_id", "finding_id").dropna().distinct()
    return dedup.retained_and_new(now, table(spark, sf, "forge_findings"), ["vfp_id", "finding_id"]).groupBy("status").agg(F.count("*").alias("n"))


_KEYED = rf"""WITH x AS (SELECT DISTINCT list_last(string_split(trim(file), '/')) AS file, regexp_replace(list_last(string_split(trim(file), '/')), '\.[^.]*$', '') AS contract,
  "function", {_SRC_HASH} AS hash, TRY_CAST(regexp_extract(vfp_id, '(\d+)', 1) AS BIGINT) AS bundle FROM forge_hyperedge_examples
  WHERE file IS NOT NULL AND "function" IS NOT NULL AND function_source IS NOT NULL),
k AS (SELECT DISTINCT file, contract, "function", hash FROM x), y AS (SELECT * FROM x WHERE bundle IS NOT NULL),
f AS (SELECT DISTINCT CAST(regexp_extract(vfp_id, '(\d+)', 1) AS BIGINT) AS bundle, list_last(string_split(file, '/')) AS file FROM (SELECT vfp_id, unnest(files) AS file FROM forge_findings)),
two AS (SELECT k.file, k.contract, k."function", k.hash, min(y.bundle) AS b FROM k JOIN y ON k.contract = y.contract AND k."function" = y."function" AND k.hash = y.hash
  JOIN f ON f.bundle = y.bundle AND f.file = k.file GROUP BY 1, 2, 3, 4),
three AS (SELECT file, min(bundle) AS b FROM f GROUP BY 1)"""
_KEY = ["contract", "function", "hash"]


def _keyed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, contents of bundles and files of bundles."""
    base = text.basename(F.trim("file"))
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint").alias("bundle")
    rows = hashed_examples(spark, sf).where("file is not null and function is not null and function_source is not null").select(
        base.alias("file"), text.stem(F.trim("file")).alias("contract"), "function", "hash", number("vfp_id")
    )
    files = table(spark, sf, "forge_findings", "vfp_id", "files").select(number("vfp_id"), F.explode("files").alias("f"))
    return rows.drop("bundle"), rows.where("bundle is not null"), files.select("bundle", text.basename(F.col("f")).alias("file"))


@query(_KEYED + """ SELECT k.file, k.contract, k."function", k.hash, coalesce(two.b, three.b) AS bundle FROM k
LEFT JOIN two ON two.file = k.file AND two.contract = k.contract AND two."function" = k."function" AND two.hash = k.hash LEFT JOIN three ON three.file = k.file""")
def b11_bundle_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """The bundle of a source by contract, function and hash among those with its file, else any with its file."""
    return joins.file_bundle(*_keyed(spark, sf), _KEY)


@query(_KEYED + """, one AS (SELECT file, contract, "function", hash, min(bundle) AS b FROM y GROUP BY 1, 2, 3, 4)
SELECT k.file, k.contract, k."function", k.hash, coalesce(one.b, two.b, three.b) AS bundle,
  CASE WHEN one.b IS NOT NULL THEN 1 WHEN two.b IS NOT NULL THEN 2 WHEN three.b IS NOT NULL THEN 3 END AS step FROM k
LEFT JOIN one ON one.file = k.file AND one.contract = k.contract AND one."function" = k."function" AND one.hash = k.hash
LEFT JOIN two ON two.file = k.file AND two.contract = k.contract AND two."function" = k."function" AND two.hash = k.hash LEFT JOIN three ON three.file = k.file""")
def b13_verified_bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The bundle of a source in three passes, the first two verified by hash."""
    return joins.resolve_bundle(*_keyed(spark, sf), _KEY)


@query("""WITH f AS (SELECT vfp_id, finding_id, min(description) AS description FROM forge_findings GROUP BY 1, 2)
SELECT example_id, description FROM forge_hyperedge_examples LEFT JOIN f USING (vfp_id, finding_id)""")
def b12_description_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """J13; repeated findings agree, the least description is taken."""
    f = table(spark, sf, "forge_findings").groupBy("vfp_id", "finding_id").agg(F.min("description").alias("description"))
    return table(spark, sf, "forge_hyperedge_examples", "example_id", "vfp_id", "finding_id").join(
        f, ["vfp_id", "finding_id"], "left"
    ).select("example_id", "description")


@query(r"""WITH n AS (SELECT DISTINCT replace(replace(unnest(files), '.sol', '.json'), 'contracts/', 'SWCsource/') AS path FROM forge_findings),
h AS (SELECT hyperedge_id, replace(replace(file, '.sol', '.json'), 'contracts/', 'SWCsource/') AS path FROM forge_constructable_hyperedges),
s AS (SELECT DISTINCT regexp_replace(list_last(string_split(path, '/')), '\.[^.]*$', '') AS stem FROM n)
SELECT CASE WHEN n.path IS NOT NULL THEN 'path' WHEN s.stem IS NOT NULL THEN 'stem' ELSE 'none' END AS found, count(*) AS n
FROM h LEFT JOIN n ON h.path = n.path LEFT JOIN s ON regexp_replace(list_last(string_split(h.path, '/')), '\.[^.]*$', '') = s.stem GROUP BY 1""")
def b14_mirrored_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Annotation files by mirrored path, else by stem."""
    mirror = lambda c: F.replace(F.replace(c, F.lit(".sol"), F.lit(".json")), F.lit("contracts/"), F.lit("SWCsource/"))
    there = table(spark, sf, "forge_findings").select(F.explode("files").alias("f")).select(mirror(F.col("f")).alias("path")).distinct()
    rows = table(spark, sf, "forge_constructable_hyperedges").select(mirror(F.col("file")).alias("path"))
    rows = rows.withColumn("stem", text.stem(F.col("path")))
    stems = there.select(text.stem(F.col("path")).alias("stem")).distinct().withColumn("by_stem", F.lit(True))
    found = rows.join(there.withColumn("by_path", F.lit(True)), "path", "left").join(stems, "stem", "left")
    return found.groupBy(F.when(F.col("by_path"), "path").when(F.col("by_stem"), "stem").otherwise("none").alias("found")).agg(F.count("*").alias("n"))


_PROB = "(('0x' || left(sha256('p:' || example_id), 6))::BIGINT % 1000) / 1000"


@query(rf"""WITH x AS (SELECT example_id, list_last(string_split(trim(file), '/')) AS file, "function" AS fn, {_SRC_HASH} AS hash, lower(trim(split)) AS split, {_PROB} AS prob
  FROM forge_hyperedge_examples JOIN split_items USING (hyperedge_id)),
p AS (SELECT file, fn, hash, arg_max(prob, example_id) AS prob FROM x WHERE split = 'test' GROUP BY 1, 2, 3)
SELECT example_id, split, CASE WHEN split = 'test' THEN p.prob END AS prob, CASE WHEN split = 'test' THEN p.prob >= 0.5 END AS caught
FROM x LEFT JOIN p USING (file, fn, hash) WHERE split IS NOT NULL""")
def b15_prediction_join(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by file, function and hash, for the test split only; of repeats the last one counts."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit("p:"), F.col("example_id").cast("string")), 256), 1, 6), 16, 10).cast("long")
    split = table(spark, sf, "split_items").select("hyperedge_id", F.lower(F.trim("split")).alias("split"))
    rows = hashed_examples(spark, sf).join(split, "hyperedge_id").where("split is not null").select(
        "example_id", "split", text.basename(F.trim("file")).alias("file"), "function", "hash", (F.pmod(h, F.lit(1000)) / 1000).alias("prob")
    )
    joined = joins.predictions_for(rows, rows.where("split = 'test'"), ["file", "function", "hash"], "example_id", "prob", F.col("split") == "test")
    return joined.select("example_id", "split", "prob", (F.col("prob") >= 0.5).alias("caught"))


_VECTOR = "[length({t}), len(string_split({t}, ' ')), length(regexp_replace({t}, '[^0-9]', '', 'g'))]"


@query(f"""SELECT vfp_id, finding_id, v[1]::DOUBLE AS n_chars, v[2]::DOUBLE AS n_words, v[3]::DOUBLE AS n_digits
FROM (SELECT vfp_id, finding_id, CASE WHEN title IS NOT NULL THEN {_VECTOR.format(t="title")} END AS v FROM forge_findings)""")
def b16_encode_gather(spark: SparkSession, sf: str) -> DataFrame:
    """Titles encoded once each and gathered to their findings."""
    df = joins.gather_by_text(table(spark, sf, "forge_findings", "vfp_id", "finding_id", "title"), "title", counting_encoder())
    at = lambda i, name: F.get("vector", F.lit(i)).cast("double").alias(name)
    return df.select("vfp_id", "finding_id", at(0, "n_chars"), at(1, "n_words"), at(2, "n_digits"))


@query(f"""WITH e AS (SELECT example_id, function_source AS src, state_vars_accessed AS sv, external_calls AS ec FROM forge_hyperedge_examples
  WHERE trim(function_source) <> '' AND len(state_vars_accessed) > 0 AND len(external_calls) > 0),
t AS (SELECT example_id, src AS t FROM e UNION ALL SELECT example_id, 'var ' || unnest(sv) FROM e UNION ALL SELECT example_id, unnest(ec) FROM e),
v AS (SELECT example_id, {_VECTOR.format(t="t")} AS v FROM t WHERE t IS NOT NULL)
SELECT example_id, count(*) AS n_nodes, sum(v[1])::DOUBLE AS n_chars, sum(v[2])::DOUBLE AS n_words, sum(v[3])::DOUBLE AS n_digits FROM v GROUP BY 1""")
def m02_features(spark: SparkSession, sf: str) -> DataFrame:
    """M2: node texts of every example (function, typed variables, calls) encoded once each and gathered; examples
    without a source, a variable or a call are skipped. Vectors are summed here to be compared."""
    e = table(spark, sf, "forge_hyperedge_examples").where("trim(function_source) <> '' and size(state_vars_accessed) > 0 and size(external_calls) > 0")
    features = joins.node_features(
        e.select("example_id", F.col("function_source").alias("function"), F.transform("state_vars_accessed", lambda v: text.typed_name(F.lit("var"), v)).alias("vars"), F.col("external_calls").alias("calls")),
        "example_id", "function", ["vars", "calls"], counting_encoder(),
    )
    total = lambda i: F.aggregate("nodes", F.lit(0.0), lambda s, n: s + F.get(n["vector"], F.lit(i)).cast("double"))
    return features.select("example_id", F.size("nodes").cast("long").alias("n_nodes"), total(0).alias("n_chars"), total(1).alias("n_words"), total(2).alias("n_digits"))


@query("""SELECT * FROM (VALUES (1, 0.75), (2, 1.0), (3, 0.0), (4, 0.865672), (5, NULL)) t(id, ratio)""")
def b17_gestalt(spark: SparkSession, sf: str) -> DataFrame:
    """F3 on hand-worked pairs: twice the letters in matching blocks by all letters."""
    rows = [
        (1, "abcd", "bcde"), (2, "", ""), (3, "abc", "xyz"), (4, "private Thread currentThread;", "private volatile Thread currentThread;"), (5, None, "a"),
    ]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    return df.select("id", F.round(joins.gestalt_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("SELECT * FROM (VALUES (1), (2), (5), (6)) t(id)")
def b18_near_known(spark: SparkSession, sf: str) -> DataFrame:
    """J10 on hand-worked rows: copies, an edit (0.992) and 18 of 20 letters (0.947) pass; 16 of 20 letters (0.889), one
    letter in 18 replaced (0.895), another file and nulls do not."""
    t = "abcdefghijklmnopqrst"
    rows = [(1, "f", t * 3), (2, "f", t * 3 + "x"), (3, "f", "z" * 60), (4, "g", t * 3), (5, "f", t), (6, "f", t[:18]), (7, "f", t[:16]), (8, "f", None), (9, None, t), (10, "f", "9" + t[:17])]
    known = spark.createDataFrame([("f", t * 3), ("f", t), (None, t)], "file string, src string")
    return joins.near_duplicates_of(spark.createDataFrame(rows, "id int, file string, src string"), known, "id", "file", "src")


@query(r"""WITH h AS (SELECT DISTINCT hyperedge_id, regexp_replace(list_last(string_split(trim(file), '/')), '\.[^.]*$', '') AS own, TRY_CAST(regexp_extract(vfp_id, '(\d+)', 1) AS BIGINT) AS bundle, external_calls AS ec
  FROM forge_constructable_hyperedges),
c AS (SELECT hyperedge_id, own, bundle, unnest(ec) AS call FROM h),
t AS (SELECT hyperedge_id, own, bundle, regexp_extract(call, '^\s*([A-Za-z_$][\w$]*)', 1) AS receiver, regexp_matches(call, '^\s*[A-Za-z_$][\w$]*\s*\(.*\)\s*\.') AS casts FROM c),
n AS (SELECT DISTINCT CAST(regexp_extract(vfp_id, '(\d+)', 1) AS BIGINT) AS bundle, regexp_replace(list_last(string_split(file, '/')), '\.[^.]*$', '') AS name FROM (SELECT vfp_id, unnest(files) AS file FROM forge_findings)),
m AS (SELECT bundle, name FROM n UNION SELECT bundle, 'I' || name FROM n),
x AS (SELECT DISTINCT t.hyperedge_id FROM t JOIN m ON m.bundle = t.bundle AND m.name = t.receiver WHERE t.casts AND t.receiver IS DISTINCT FROM t.own)
SELECT hyperedge_id, hyperedge_id IN (SELECT hyperedge_id FROM x) AS is_cross,
  coalesce(bool_or(t.own IS NOT NULL AND receiver <> '' AND receiver <> t.own AND receiver <> 'this'), false) AS leaves FROM h LEFT JOIN t USING (hyperedge_id) GROUP BY 1""")
def b19_cross_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a cast in any call names another contract of the bundle (a file's name, or an interface of
    it), and whether any receiver is neither the contract nor this."""
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint").alias("bundle")
    h = table(spark, sf, "forge_constructable_hyperedges").select(
        "hyperedge_id", text.stem(F.trim("file")).alias("own"), number("vfp_id"), F.col("external_calls").alias("ec")
    ).distinct()
    calls = h.select("hyperedge_id", "own", "bundle", F.explode_outer("ec").alias("call")).withColumn("receiver", F.nullif(text.call_receiver(F.col("call")), F.lit("")))
    casts = calls.where(F.col("call").rlike(r"\A\s*[A-Za-z_$][\w$]*\s*\(.*\)\s*\."))
    stems = table(spark, sf, "forge_findings", "vfp_id", "files").select(number("vfp_id"), F.explode("files").alias("f")).select("bundle", text.stem(F.col("f")).alias("s")).distinct()
    names = stems.select("bundle", F.explode(F.array("s", F.concat(F.lit("I"), F.col("s")))).alias("name")).distinct()
    cross = joins.cross_contract(casts.withColumnRenamed("receiver", "target"), names, "hyperedge_id").withColumn("is_cross", F.lit(True))
    leaves = rules.leaves_contract(F.array("receiver"), F.col("own"), F.array().cast("array<string>"))
    return calls.groupBy("hyperedge_id").agg(F.max(leaves).alias("leaves")).join(cross, "hyperedge_id", "left").select(
        "hyperedge_id", F.coalesce("is_cross", F.lit(False)).alias("is_cross"), "leaves"
    )
