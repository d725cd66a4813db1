"""Sources, sinks and whole sources of code (S1-S11, C1-C16, J3, J5, J6, G4) over the small files in ``weftline/fixtures``.

The expected rows are worked out by hand from those files; sinks are compared with the tables they write.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import rules, solidity, text
from weftline.operators import aggregates, hyperedges, joins, metrics
from weftline.plans.evaluation import _SCORED, scored
from weftline.plans.registry import query, table
from weftline.session import new_path
from weftline.sources import io

FIXTURES = (Path(__file__).resolve().parent.parent / "fixtures").as_uri()


@query("""SELECT * FROM (VALUES ('vfp_00001', 0, 1, 'Reentrancy in deposit', 'High', 2), ('vfp_00001', 1, 2, 'Stale price', 'Low', 1)) t(vfp_id, ord, id, title, severity, n_locations)""")
def s01_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of a folder of bundles."""
    found = io.findings_of(io.read_bundles(spark, f"{FIXTURES}/bundles"))
    return found.select("vfp_id", "ord", "id", "title", "severity", F.size("location").alias("n_locations"))


@query("""SELECT * FROM (VALUES ('vfp_00001', 2, 'src/Vault.sol Oracle.sol'), ('vfp_00002', 0, 'Oracle.sol')) t(stem, n_findings, files)""")
def s02_stems(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles by the stem of their file."""
    return io.read_bundles(spark, f"{FIXTURES}/bundles").select("stem", F.size("findings").alias("n_findings"), F.array_join(F.map_keys("affected_files"), " ").alias("files"))


@query("""SELECT * FROM (VALUES ('Vault.sol', 0, 'SWC-107', 'deposit', 17, 20, true), ('Vault.sol', 1, 'SWC-104', 'N/A', 9, 9, false), ('Vault.sol', 2, 'SWC-100', 'quote', 0, 999999, false),
  ('Oracle.sol', 0, 'SWC-112', 'price', 4, 7, true), ('Gone.sol', 0, 'SWC-107', 'x', 0, 999999, true)) t(file, ord, code, "function", start, stop, kept)""")
def s03_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """A tree of annotations; kept are interaction codes with a function."""
    lines, code = text.parse_line_range(F.col("lineNumber")), text.code_of(F.col("category"))
    return io.read_annotations(spark, f"{FIXTURES}/annotations").select(
        text.basename(F.col("filePath")).alias("file"), "ord", code.alias("code"), "function", lines["start"].alias("start"), lines["stop"].alias("stop"),
        (code.isin(rules.INTERACTION_SWCS) & ~F.col("function").isin("", "N/A")).alias("kept"),
    )


@query("""SELECT * FROM (VALUES ('contracts/demo/src/Vault.sol', 26), ('contracts/demo/src/Oracle.sol', 15)) t(path, n_lines)""")
def s04_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Every source below a folder."""
    return io.read_sources(spark, f"{FIXTURES}/contracts").select(
        F.regexp_extract("path", r"(contracts/.*)\z", 1).alias("path"), F.length(F.regexp_replace("text", r"[^\n]", "")).alias("n_lines")
    )


@query("""SELECT * FROM (VALUES ('library', 'Guard.sol', 4)) t(bundle, file, n_lines)""")
def s05_library(spark: SparkSession, sf: str) -> DataFrame:
    """A library as one bundle."""
    return io.read_sources(spark, f"{FIXTURES}/library", bundle="library").select(
        "bundle", text.basename(F.col("path")).alias("file"), F.length(F.regexp_replace("text", r"[^\n]", "")).alias("n_lines")
    )


@query("""SELECT * FROM (VALUES (1, 'deposit', 1, 1), (2, 'noop', 0, 0), (3, NULL, 0, NULL)) t(id, name, label, n_vars)""")
def s06_items(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON array with a given schema."""
    items = io.read_items(spark, f"{FIXTURES}/items.json", "id int, name string, label int, vars array<string>")
    return items.select("id", "name", "label", F.when(F.col("vars").isNotNull(), F.size("vars")).alias("n_vars"))


@query("""SELECT * FROM (VALUES ('Vault.sol', 3, 1), ('Oracle.sol', 1, 1)) t(file, n_annotations, missing)""")
def s07_existing(spark: SparkSession, sf: str) -> DataFrame:
    """Annotations of files that exist, and how many have none."""
    notes = io.read_annotations(spark, f"{FIXTURES}/annotations").select(F.regexp_extract("filePath", r"(contracts/.*)\z", 1).alias("path"))
    listing = io.read_sources(spark, f"{FIXTURES}/contracts").select(F.regexp_extract("path", r"(contracts/.*)\z", 1).alias("path"))
    there, missing = io.with_existing(notes, listing, "path")
    return there.groupBy(text.basename(F.col("path")).alias("file")).agg(F.count(F.lit(1)).alias("n_annotations")).crossJoin(missing)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s08_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A table written as JSON in folders by a column, and read again."""
    path = new_path(spark, "sink")
    io.write_items(table(spark, sf, "nation"), path, "json", ["n_regionkey"])
    return spark.read.schema("n_nationkey int, n_name string, n_regionkey int").json(path)


@query(r"""WITH r AS (SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1),
l AS (SELECT list('| ' || r_name || ' | ' || n || ' |' ORDER BY r_name) AS rows FROM r)
SELECT unnest(range(1, len(x) + 1)) AS line_no, unnest(x) AS line FROM (SELECT list_concat(list_concat(['# Nations', '', '## by region', '', '| r_name | n |', '|---|---|'], rows), ['']) AS x FROM l)""")
def s09_report(spark: SparkSession, sf: str) -> DataFrame:
    """A report of an aggregate, line by line."""
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = io.render_report("Nations", {"by region": aggregates.count_by(joined, "r_name").orderBy("r_name")}).split("\n")
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(lines)], "line_no long, line string")


@query("""SELECT * FROM (VALUES ('W', 0, 1.5), ('W', 1, -2.0), ('W', 2, 0.0), ('W', 3, 4.25), ('b', 0, 0.5)) t(name, pos, value)""")
def s10_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of a model saved and loaded with their shapes."""
    path = new_path(spark, "weights")
    io.save_weights(spark, {"W": np.array([[1.5, -2.0], [0.0, 4.25]]), "b": np.array(0.5)}, path)
    back = io.load_weights(spark, path)
    rows = [(n, i, float(x)) for n, v in back.items() for i, x in enumerate(np.ravel(v)) if v.shape == {"W": (2, 2), "b": ()}[n]]
    return spark.createDataFrame(rows, "name string, pos int, value double")


@query(_SCORED + """, p AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS r, count(*) OVER () AS n FROM s WHERE label = 1)
SELECT CAST(floor(score * 10000 + 1e-9) AS BIGINT) / 10000 AS best_threshold FROM p WHERE r = ceil(0.95 * n - 1e-9)""")
def s11_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold that keeps the recall, saved as a configuration and loaded."""
    path = new_path(spark, "threshold")
    io.save_weights(spark, {"best_threshold": metrics.threshold_at_recall(scored(spark, sf), "label", "score").first()["threshold"]}, path)
    return spark.createDataFrame([(float(io.load_weights(spark, path)["best_threshold"]),)], "best_threshold double")


def _files(spark: SparkSession) -> DataFrame:
    return io.files_of(io.read_bundles(spark, f"{FIXTURES}/bundles")).select(F.col("vfp_id").alias("bundle"), "file", F.col("ord").alias("place"), "text")


@query("""SELECT * FROM (VALUES
  ('vfp_00001', 'src/Vault.sol', 'IToken', 'interface', '', '', 'transferFrom balanceOf'), ('vfp_00001', 'src/Vault.sol', 'Base', 'contract', '', 'token:IToken balances:mapping(address=>uint256)', 'sweep'),
  ('vfp_00001', 'src/Vault.sol', 'Vault', 'contract', 'Base', 'total:uint256 oracle:Oracle', 'deposit quote noop'),
  ('vfp_00001', 'Oracle.sol', 'Oracle', 'contract', '', 'owner:address last:uint256', 'price'), ('vfp_00001', 'Oracle.sol', 'MathLib', 'library', '', '', 'half'),
  ('vfp_00001', 'Oracle.sol', 'Lender', 'contract', 'Base', 'fee:uint256', ''),
  ('vfp_00002', 'Oracle.sol', 'Oracle', 'contract', '', 'owner:address last:uint256', 'price'), ('vfp_00002', 'Oracle.sol', 'MathLib', 'library', '', '', 'half'),
  ('vfp_00002', 'Oracle.sol', 'Lender', 'contract', 'Base', 'fee:uint256', '')) t(bundle, file, name, kind, bases, variables, functions)""")
def j02_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts, interfaces and libraries of every file with what they declare."""
    typed = F.transform("state_vars", lambda v: F.concat(v, F.lit(":"), F.regexp_replace(F.try_element_at("types", v), " ", "")))
    return hyperedges.parsed_contracts(_files(spark)).select(
        "bundle", "file", "name", "kind", F.array_join("bases", " ").alias("bases"), F.array_join(typed, " ").alias("variables"), F.array_join("functions.name", " ").alias("functions")
    )


@query("""SELECT * FROM (VALUES
  ('vfp_00001', 'Base', 'sweep', 'balances token', 'state-var:token.transferFrom', true, false, false, true, true, 4),
  ('vfp_00001', 'Vault', 'deposit', 'balances token total', 'state-var:token.transferFrom', true, true, true, true, true, 5),
  ('vfp_00001', 'Vault', 'quote', 'balances oracle total', 'state-var:oracle.price', true, true, false, true, true, 5),
  ('vfp_00001', 'Vault', 'noop', '', '', false, false, false, false, false, 1),
  ('vfp_00001', 'Oracle', 'price', 'last owner', 'low-level:owner.call cast:IFeed.latestAnswer', true, false, false, false, true, 5),
  ('vfp_00001', 'MathLib', 'half', '', '', false, false, false, false, false, 1),
  ('vfp_00002', 'Oracle', 'price', 'last owner', 'low-level:owner.call cast:IFeed.latestAnswer', true, false, false, false, true, 5),
  ('vfp_00002', 'MathLib', 'half', '', '', false, false, false, false, false, 1))
  t(bundle, contract, "function", state_vars, calls, constructable, inherited_vars_used, inherited_calls_used, is_cross, leaves, n_nodes)""")
def j03_hyperedges(spark: SparkSession, sf: str) -> DataFrame:
    """The hyperedge of every function with a body."""
    said = F.transform("calls", lambda c: F.concat(c["kind"], F.lit(":"), c["receiver"], F.lit("."), c["method"]))
    return hyperedges.hyperedges_of(_files(spark)).select(
        "bundle", "contract", "function", F.array_join("state_vars", " ").alias("state_vars"), F.array_join(said, " ").alias("calls"), "constructable",
        "inherited_vars_used", "inherited_calls_used", "is_cross", "leaves", "n_nodes",
    )


@query("""SELECT * FROM (VALUES ('deposit', 'call:token.transferFrom(msg.sender, address(this), amou read:token write:balances write:total'),
  ('quote', 'read:balances call:oracle.price(user) read:oracle read:total'), ('noop', ''), ('sweep', 'call:token.transferFrom(address(this), to, balances[to] read:token read:balances'),
  ('price', 'call:owner.call{value: 1}("") read:owner write:last call:IFeed(owner).latestAnswer() read:owner read:last'), ('half', '')) t("function", events)""")
def j04_events(spark: SparkSession, sf: str) -> DataFrame:
    """Reads, writes and calls of each function in the order of the text."""
    said = F.transform("events", lambda e: F.concat(e["kind"], F.lit(":"), e["name"]))
    return hyperedges.hyperedges_of(_files(spark)).where("bundle = 'vfp_00001'").select("function", F.array_join(said, " ").alias("events"))


@query("""SELECT * FROM (VALUES ('src/Vault.sol', 'balances token'), ('Oracle.sol', 'last owner')) t(file, variables)""")
def j05_variables(spark: SparkSession, sf: str) -> DataFrame:
    """Variables of the first contract of a file, by expressions."""
    return solidity.variables_of(_files(spark).where("bundle = 'vfp_00001'"), "file", "text").select("file", F.array_join("variables", " ").alias("variables"))


@query("""SELECT * FROM (VALUES ('src/Vault.sol', 'deposit', 'Vault'), ('src/Vault.sol', 'transferFrom', 'IToken'), ('src/Vault.sol', 'price', 'Oracle'), ('Oracle.sol', 'sweep', 'Lender'),
  ('Oracle.sol', 'half', 'MathLib'), ('Oracle.sol', 'nothing', 'Lender'), ('Gone.sol', 'sweep', 'Base'), ('Gone.sol', 'nothing', 'Lender')) t(file, "function", owner)""")
def b20_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Which contract a located function belongs to, by each of the six steps but an inherited one of another file."""
    contracts = hyperedges.parsed_contracts(_files(spark))
    asked = [("src/Vault.sol", "deposit"), ("src/Vault.sol", "transferFrom"), ("src/Vault.sol", "price"), ("Oracle.sol", "sweep"), ("Oracle.sol", "half"), ("Oracle.sol", "nothing"), ("Gone.sol", "sweep"), ("Gone.sol", "nothing")]
    calls = spark.createDataFrame([("vfp_00001", *a) for a in asked], "bundle string, file string, function string")
    known = hyperedges.inheritance(contracts).select("bundle", "name", "functions")
    return joins.resolve_owner(calls, contracts.withColumn("functions", F.col("functions.name")), known).select("file", "function", "owner")


@query("""SELECT * FROM (VALUES ('Vault.sol', 'deposit', 'Vault', 'deposit', true), ('Vault.sol', 'N/A', 'Base', 'sweep', false), ('Vault.sol', 'quote', 'Vault', 'quote', true),
  ('Oracle.sol', 'price', 'Oracle', 'price', true)) t(file, annotated, contract, "function", named)""")
def b21_annotated(spark: SparkSession, sf: str) -> DataFrame:
    """The function that an annotation's lines meet, the one of its name first, else the first in the text, with
    the contract around it."""
    sources = io.read_sources(spark, f"{FIXTURES}/contracts").select(F.lit("x").alias("bundle"), text.basename(F.col("path")).alias("file"), F.lit(0).alias("place"), "text")
    lines = lambda c: text.line_of(F.col("text"), F.col(c))
    found = hyperedges.parsed_contracts(sources).select("bundle", "file", F.col("name").alias("contract"), F.explode("functions").alias("f")).where("f.has_body").join(sources.select("file", "text"), "file").select(
        "file", "contract", F.col("f.name").alias("function"), F.col("f.start").alias("at"), lines("f.start").alias("first"), lines("f.end").alias("last")
    )
    span = text.parse_line_range(F.col("lineNumber"))
    notes = io.read_annotations(spark, f"{FIXTURES}/annotations").select(text.basename(F.col("filePath")).alias("file"), F.col("function").alias("annotated"), "ord", span["start"].alias("s"), span["stop"].alias("e"))
    met = joins.overlapping(notes, found, ["file"], ("s", "e"), ("first", "last"))
    best = F.min(F.struct((F.col("annotated") != F.col("function")).alias("other"), "at", "contract", "function"))
    return met.groupBy("file", "ord", "annotated").agg(best.alias("b")).select("file", "annotated", "b.contract", "b.function", (~F.col("b.other")).alias("named"))

