"""Hyperedges from source files: one function, the state variables it touches, the calls it makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import rules, solidity
from weftline.functions.text import source_hash
from weftline.operators import closure, joins
from weftline.session import materialize, scratch


def _node(bundle: str, name: Column) -> Column:
    return F.concat_ws("\0", F.col(bundle), name)


def parsed_contracts(files: DataFrame) -> DataFrame:
    """The contracts of ``files`` (``bundle, file, place, text``): one row each, with ``ord`` in order of files
    and of the text within a bundle, and its ``node``. Each source is parsed once; written to the shared folder.

    Of several contracts of one name in a bundle the last one counts for inheritance.
    """
    got = solidity.contracts_of(files.select("bundle", "file", "text")).join(files.select("bundle", "file", "place"), ["bundle", "file"])
    ord_ = F.col("place").cast("long") * (1 << 20) + F.col("ord")
    return materialize(got.withColumn("ord", ord_).drop("place").withColumn("node", _node("bundle", F.col("name"))), "contracts")


def inheritance(contracts: DataFrame) -> DataFrame:
    """``bundle, name, node, visible, types, functions, own``: what each contract has or inherits: its state
    variables with their types (G1, G2), names of functions, and its own variables."""
    last = contracts.groupBy("node").agg(F.max_by(F.struct("bundle", "name", "bases", "state_vars", "types", "functions"), "ord").alias("c")).select("node", "c.*")
    with scratch(contracts.sparkSession) as keep:
        edges = last.select("node", "bundle", F.posexplode("bases").alias("ord", "b")).select("node", _node("bundle", F.col("b")).alias("base"), "ord")
        paths = materialize(closure.ancestor_paths(last.select("node"), edges), "paths")
        typed = closure.nearest_wins(paths, last.select("node", F.explode("types").alias("name", "value")))
        functions = closure.inherited_set(paths, last.select("node", F.explode("functions.name").alias("name")))
        # a contract's own members and those of its bases: as many as its sources declare
        types = typed.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("types"))
        names = functions.groupBy("node").agg(F.array_sort(F.collect_set("name")).alias("functions"))
        every = last.select("bundle", "name", "node", F.col("state_vars").alias("own")).join(types, "node", "left").join(names, "node", "left")
        out = materialize(every.select(
            "bundle", "name", "node", "own", F.coalesce("types", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")).alias("types"),
            F.coalesce("functions", F.array().cast("array<string>")).alias("functions"),
        ).withColumn("visible", F.array_sort(F.map_keys("types"))), "inheritance")
        keep(out)
    return out


def hyperedges_of(files: DataFrame) -> DataFrame:
    """A row for each function with a body: ``bundle, file, contract, function, state_vars, calls, events, constructable,
    inherited_vars_used, inherited_calls_used, is_cross, leaves, n_nodes, hash``.

    ``files`` has ``bundle, file, place, text``; ``calls`` are those that leave the contract, as structs of ``kind,
    method, receiver, target``. A hyperedge is constructable with a variable and a call (P12), crosses
    contracts if a call's type is another contract of the bundle (C11), leaves its own if a receiver is
    neither the contract, ``this`` nor a base (C12). Files without contracts and null texts give none.
    """
    contracts = parsed_contracts(files)
    known = inheritance(contracts)
    bodies = contracts.select("bundle", "file", "name", "node", "bases", F.explode("functions").alias("f")).where("f.has_body")
    src = F.substring(F.col("text"), F.col("f.start") + 1, F.col("f.end") - F.col("f.start"))
    rows = bodies.join(files.select("bundle", "file", "text"), ["bundle", "file"]).select(
        "bundle", "file", F.col("name").alias("contract"), "node", "bases", F.col("f.name").alias("function"), F.col("f.start").alias("start"), src.alias("src")
    ).join(known.select("node", "own", "types", "visible"), "node")
    keyed = materialize(rows.withColumn("key", F.concat_ws("\0", "bundle", "file", F.col("start").cast("string"))), "functions")
    built = solidity.functions_of(keyed, "key", "src", "visible").withColumnRenamed("calls", "found")
    both = keyed.join(built, "key")

    def classified(c: Column) -> Column:
        declared, local = F.try_element_at("types", c["receiver"]), F.try_element_at("locals", c["receiver"])
        scope = F.when(declared.isNotNull(), "state").when(local.isNotNull(), "local")
        type_ = F.coalesce(declared, local)
        kind = rules.classify_call(c["method"], c["receiver"], type_, scope, c["is_cast"])
        return F.struct(kind.alias("kind"), c["method"].alias("method"), c["receiver"].alias("receiver"), rules.type_of_call(kind, c["receiver"], type_).alias("target"))

    calls = F.filter(F.transform("found", classified), lambda c: c["kind"].isNotNull())
    edges = materialize(both.withColumn("calls", calls).drop("found"), "edges")
    targets = edges.select("key", "bundle", F.col("contract").alias("own"), F.explode("calls.target").alias("target"))
    cross = joins.cross_contract(targets, contracts.select("bundle", "name"), "key").withColumn("__cross", F.lit(True))
    receivers = F.col("calls.receiver")
    used, called = closure.inherited_use(F.col("identifiers"), F.col("own"), receivers, F.col("visible"))
    return edges.join(cross, "key", "left").select(
        "bundle", "file", "contract", "function", F.col("identifiers").alias("state_vars"), "calls", "events",
        ((F.size("identifiers") > 0) & (F.size("calls") > 0)).alias("constructable"), used.alias("inherited_vars_used"), called.alias("inherited_calls_used"),
        F.coalesce("__cross", F.lit(False)).alias("is_cross"), rules.leaves_contract(receivers, F.col("contract"), F.col("bases")).alias("leaves"),
        (1 + F.size("identifiers") + F.size("calls")).alias("n_nodes"), source_hash(F.col("src")).alias("hash"),
    )
