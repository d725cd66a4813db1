"""Hand-worked cases of the core operators."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import rules, solidity, text
from weftline.operators import aggregates, augment, closure, dedup, joins, metrics, sampling, vectors
from weftline.operators.components import connected_components, spanning_forest, star_edges


def value(spark, column, schema="x string", rows=(("",),)):
    return spark.createDataFrame(list(rows), schema).select(column.alias("v")).first()["v"]


def test_normalize_source(spark):
    src = "function f(){ /* a\n b */ x = 1; // http\r still\n Y >= 2; }"
    assert value(spark, text.normalize_source(F.col("x")), rows=[(src,)]) == "functionf(){x=1;y>=2;}"
    assert value(spark, text.source_hash(F.col("x")), rows=[("A b",)]) == hashlib.sha256(b"ab").hexdigest()
    assert value(spark, text.source_hash(F.col("x")), rows=[(None,)]) is None


@pytest.mark.parametrize("given, want", [
    ("L175-216", (175, 216)), ("L70 - L105", (70, 105)), ("L78", (78, 78)), ("", (0, 999999)), (None, (0, 999999)),
    ("abc", (0, 999999)), ("L1-2-3", (1, 2)),
])
def test_line_ranges(spark, given, want):
    assert tuple(value(spark, text.parse_line_range(F.col("x")), rows=[(given,)])) == want


def test_locations(spark):
    got = value(spark, text.parse_location(F.col("x")), rows=[("a.sol::f#L1-L2",)])
    assert tuple(got) == ("a.sol", "f", "L1-L2")
    assert tuple(value(spark, text.parse_location(F.col("x")), rows=[("a.sol#L5",)])) == ("a.sol", None, "L5")


def test_interval_join(spark):
    a = spark.createDataFrame([("f", 10, 12), ("f", 10, 11), (None, 1, 2)], "k string, s int, e int")
    b = spark.createDataFrame([("f", 12, 20), (None, 1, 2)], "k string, s2 int, e2 int")
    want = {(10, 12, 12, 20)}
    for got in (joins.overlapping(a, b, ["k"], ("s", "e"), ("s2", "e2")), joins.overlapping_in_blocks(a, b, ["k"], ("s", "e"), ("s2", "e2"), 3)):
        assert {tuple(r)[1:] for r in got.collect()} == want


def test_components(spark):
    rows = [("p1", 1, "h1"), ("p2", 2, "h1"), ("p2", 2, "h2"), ("p3", 3, "h2"), ("p4", 4, "h3"), ("x", None, "h1")]
    df = spark.createDataFrame(rows, "name string, p bigint, h string")
    got = {r["node"]: r["component"] for r in connected_components(star_edges(df, "p", "h")).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
    empty = spark.createDataFrame([], "a bigint, b bigint")
    assert connected_components(empty).count() == 0
    loop = spark.createDataFrame([(7, 7), (1, None)], "a bigint, b bigint")
    assert [tuple(r) for r in connected_components(loop).collect()] == [(7, 7)]


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(3)
    chain = np.c_[np.arange(300), np.arange(1, 301)]
    star = np.c_[np.full(200, 1000), np.arange(1001, 1201)]
    wild = rng.integers(2000, 2600, (250, 2))
    edges = np.concatenate([chain, star, wild])
    edges = edges[rng.permutation(len(edges))]
    u, v = spanning_forest(edges[:, 0], edges[:, 1])
    want = {int(a): int(b) for a, b in zip(u, v)}
    df = spark.createDataFrame([tuple(map(int, e)) for e in edges], "a bigint, b bigint").repartition(7)
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {n: want.get(n, n) for n in map(int, np.unique(edges))}


def _hierarchy(spark, edges):
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    return closure.ancestor_paths(
        spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "node string, base string, ord int")
    )


def test_closures(spark):
    diamond = _hierarchy(spark, [("A", "B", 0), ("A", "C", 1), ("B", "X", 0), ("C", "X", 0)])
    f = spark.createDataFrame([("B", "f"), ("X", "f")], "node string, name string")
    owner = {r["node"]: r["owner"] for r in closure.last_base_wins(diamond, f).collect()}
    assert owner["A"] == "B" and owner["C"] == "X"
    two = _hierarchy(spark, [("A", "B", 0), ("A", "C", 1)])
    x = [("B", "x", "uint"), ("C", "x", "address")]
    near = lambda rows: {r["node"]: r["value"] for r in closure.nearest_wins(two, spark.createDataFrame(rows, "node string, name string, value string")).collect()}
    assert near(x)["A"] == "uint"
    assert near([*x, ("A", "x", "bool")])["A"] == "bool"
    cycle = _hierarchy(spark, [("A", "B", 0), ("B", "A", 0)])
    own = spark.createDataFrame([("A", "a"), ("B", "b")], "node string, name string")
    got = {(r["node"], r["name"]) for r in closure.inherited_set(cycle, own).collect()}
    assert got == {("A", "a"), ("A", "b"), ("B", "a"), ("B", "b")}


def _scores(spark):
    return spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.30005), (0, 0.85), (0, 0.1), (None, 0.5), (1, None)], "y int, s double")


def test_metrics(spark):
    t = metrics.threshold_at_recall(_scores(spark), "y", "s").first()
    assert (t["threshold"], t["recall_at"], t["n_pos"]) == (0.3, 1.0, 3)
    c = metrics.confusion(_scores(spark), "y", "s", 0.3).first()
    assert (c["tp"], c["fp"], c["fn"]) == (3, 1, 0) and round(c["f1"], 6) == 0.857143
    assert round(metrics.roc_auc(_scores(spark), "y", "s").first()[0], 6) == 0.666667
    assert round(metrics.pr_auc(_scores(spark), "y", "s").first()[0], 6) == 0.763889
    none = _scores(spark).where("y = 0")
    assert metrics.threshold_at_recall(none, "y", "s").first()["threshold"] == 0.0
    assert metrics.roc_auc(none, "y", "s").first()[0] == 0.0


@pytest.mark.parametrize("pos, want", [((15, 15), (40, 40)), ((10, 10), (30, 30))])
def test_quota(spark, pos, want):
    flags = lambda t, f: spark.createDataFrame([(True,)] * t + [(False,)] * f, "x boolean")
    got = sampling.balanced_quota(flags(100, 40), flags(*pos), "x").first()
    assert tuple(got) == want


def test_vulnerability_types(spark):
    for title, want in {"Unchecked callback": "Reentrancy (SWC-107)", "DELEGATECALL misuse": "Delegatecall (SWC-112)", "Bad math": "Reentrancy (SWC-107)", None: "Reentrancy (SWC-107)"}.items():
        assert value(spark, rules.vulnerability_type(F.col("x")), rows=[(title,)]) == want


@pytest.mark.parametrize("view, methods, want", [
    (True, ["latestRoundData"], True), (True, ["mystery"], False), (False, ["balanceOf"], False), (True, [], True),
])
def test_label_rule(spark, view, methods, want):
    got = value(spark, rules.label_is_invalid(F.lit("SWC-104"), F.col("v"), F.col("m")), "v boolean, m array<string>", [(view, methods)])
    assert got is want


@pytest.mark.parametrize("name, want", [("uint256", False), ("mapping(address => IToken)", True), ("Order[]", True), ("address payable", False), (None, False)])
def test_contract_types(spark, name, want):
    assert value(spark, rules.is_contract_type(F.col("x")), rows=[(name,)]) is want


def test_first_filled(spark):
    assert value(spark, rules.first_filled(F.lit(""), F.lit("x"))) == "x"
    assert value(spark, rules.first_filled(F.lit(None).cast("string"), F.lit(""))) == ""


def test_first_wins(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("b", 2, "q"), ("a", 3, "r"), (None, 4, "s"), (None, 5, "t")], "k string, o int, v string")
    assert {tuple(r) for r in dedup.first_wins(df, ["k"], ["o"]).collect()} == {("a", 1, "p"), ("b", 2, "q"), (None, 4, "s")}


def test_variants_use_up_their_hash_only_when_accepted(spark):
    df = spark.createDataFrame([(1, 1, "h", "sequence_order_changed"), (1, 2, "h", None), (1, 3, "h", None)], "i int, v int, h string, reason string")
    got = {r["v"]: r["reason"] for r in augment.first_accepted(df, "i", "v", "h").collect()}
    assert got == {1: "sequence_order_changed", 2: None, 3: "duplicate_variant"}


VAULT = """interface IToken { function transferFrom(address a, address b, uint256 c) external returns (bool); }
contract Base { IToken token; mapping(address => uint256) balances; }
contract Vault is Base {
  uint256 total;
  function deposit(uint256 amount) external {
    token.transferFrom(msg.sender, address(this), amount);
    balances[msg.sender] += amount;
    total += amount;
  }
  function noop() external pure {}
}"""


def test_hyperedge_of_a_source(spark):
    found = {c["name"]: c for c in solidity.parse_contracts(VAULT)}
    assert found["Vault"]["bases"] == ["Base"] and found["Base"]["types"]["token"] == "IToken"
    src = solidity.extract_function(VAULT, "deposit")
    t = solidity.scan(src)
    loc, names = solidity.local_types(t), {"token", "balances", "total"}
    assert sorted({x for _, x in solidity.accesses(t, names, loc)}) == ["balances", "token", "total"]
    (call,) = solidity.member_calls(t, src)
    row = spark.createDataFrame([(call["method"], call["receiver"], "IToken", "state", call["is_cast"])], "m string, r string, t string, s string, c boolean")
    kind = lambda m: row.select(rules.classify_call(m, F.col("r"), F.col("t"), F.col("s"), F.col("c")).alias("k")).first()["k"]
    assert kind(F.col("m")) == "state-var"
    assert kind(F.lit("transfer")) == "low-level"
    assert solidity.extract_function(VAULT, "missing") is None
    assert solidity.parse_contracts("contract Broken { function f( {") is not None


def test_transforms():
    src = "function f(uint a) external { uint b = a; x.go(b); y = b; }"
    renamed, back = augment.renamed(solidity.scan(src), src, "aug1", {"y"})
    assert "uint b_aug1 = a_aug1" in renamed and "x.go(b_aug1)" in renamed and back == {"a_aug1": "a", "b_aug1": "b"}
    assert "_inert_val_7 = 7 + 8" in augment.inject(src, True, 7)
    assert augment.inject("no body", True, 1) == "no body"


def test_spread_and_funnel(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 300.0), ("a", None), ("b", None)], "k string, v double")
    got = {r["k"]: r for r in aggregates.spread(df, ["k"], "v", 256).collect()}
    assert got["a"]["middle"] == 3.0 and got["a"]["n"] == 3 and round(got["a"]["share_above"], 6) == 0.333333
    assert got["b"]["n"] == 0 and got["b"]["middle"] is None
    steps = aggregates.funnel(df, {"all": F.lit(True), "filled": F.col("v").isNotNull(), "large": F.col("v") > 2}).collect()
    assert [r["n"] for r in steps] == [5, 3, 2]


def test_attention_pool(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None)], "g int, v array<float>")
    got = vectors.attention_pool(df, "g", "v", [1.0, -1.0]).collect()
    e = np.exp([np.tanh(1), -np.tanh(1)])
    assert len(got) == 1 and np.allclose(got[0]["pooled"], e / e.sum())


def test_head_learns():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] > 0).astype(int)
    p = vectors.train_head(x, y, epochs=60, rate=0.01)
    z = np.maximum(x @ p["W1"].T + p["b1"], 0) @ p["W2"] + p["b2"]
    assert ((z > 0) == y).mean() > 0.9


def test_near_duplicates(spark):
    known = spark.createDataFrame([("f", "abcdefghij" * 5)], "b string, t string")
    rows = spark.createDataFrame([(1, "f", "abcdefghij" * 5), (2, "f", "abcdefghij" * 5 + "x"), (3, "f", "z" * 50), (4, "g", "abcdefghij" * 5), (5, "f", None)], "i int, b string, t string")
    assert {r["i"] for r in joins.near_duplicates_of(rows, known, "i", "b", "t").collect()} == {1, 2}


def test_steps_in_python_agree_with_those_in_the_jvm(spark, sf):
    rows = spark.read.parquet(f"{sf}/forge_hyperedge_examples.parquet").where("function_source is not null").select(
        "function_source", text.clean_comments(F.col("function_source")).alias("c"), text.swap_literals(F.col("function_source")).alias("s")
    ).collect()
    odd = ["a //b\r c\n /*x*/ y", "uint x = 0x0; uint256 y", "address(0) uint256\u00a0 z", "\x1c a \u2003b", ""]
    extra = spark.createDataFrame([(x,) for x in odd], "t string").select("t", text.clean_comments(F.col("t")).alias("c"), text.swap_literals(F.col("t")).alias("s")).collect()
    for src, c, s in map(tuple, rows + extra):
        assert (augment.cleaned(src), augment.swapped(src)) == (c, s)


def test_an_exception_is_a_reason(spark):
    df = spark.createDataFrame([(i, "function f() { token.go(); total = 1; }", 0, ["token"], {"token": "IToken"}) for i in (1, 2)], "i int, s string, y int, v array<string>, types map<string,string>")
    made = augment.variants(df, "i", "s", "y", "v", "types")
    failed = made.withColumn("error", F.when((F.col("variant") == 2) & (F.col("i") == 1), "KeyError").otherwise(F.col("error")))
    own = df.select("i", text.source_hash(F.col("s")).alias("own_hash"))
    reasons = {(r["i"], r["variant"]): r["reason"] for r in augment.verify(failed, "i", own, own.limit(0).select(F.col("own_hash").alias("hash"))).collect()}
    assert reasons == {(1, 1): "duplicate_variant", (1, 2): "exception_KeyError", (2, 1): "duplicate_variant", (2, 2): None}


def test_a_parse_needs_no_early_function():
    src = "/* note */ " + "uint x; " * 700 + "function f(uint[2][3] memory a, mapping(address => uint) storage b) internal { (a, b.c) = g(a); total = 1; }"
    got = augment.structure(src, {"total"}, {})
    assert got["parsed"] and got["vars"] == ["total"] and ("write", "total") in got["events"]
    deep = "function f() { (" + ", ".join(f"v{i}" for i in range(40)) + ", total) = g(); }"
    assert ("write", "v0") in augment.structure(deep, {"v0"}, {})["events"]


def test_variables_by_expressions():
    src = "contract A is B {\n  uint256 public total;\n  mapping(address => uint) private held;\n  IToken token = IToken(x);\n  event E(uint a);\n  struct S {\n    uint inner;\n  }\n  function f() external {\n    if (a) { uint z = 1; }\n    uint y;\n  }\n  bool done; }\n uint after;\n"
    assert solidity.contract_variables(src) == {"total", "held", "token"}
    assert solidity.contract_variables("contract A {\n uint a;\n function f() {\n uint b;\n") == {"a"}
    assert solidity.contract_variables("no contrac") == set() and solidity.contract_variables("") == set()


def test_names_with_signs_stand_for_themselves(spark):
    df = spark.createDataFrame([("a$b = 1;", ["a$b"]), ("axb = 1;", ["a.b"]), ("x = 1;", ["("])], "s string, v array<string>")
    assert [r[0] for r in df.select(text.writes_any(F.col("s"), F.col("v"))).collect()] == [True, False, False]


def test_wide_ranges_are_not_cut(spark):
    rng = np.random.default_rng(1)
    rows = [("f", int(a), int(a + rng.integers(0, 30))) for a in rng.integers(0, 400, 60)] + [("f", 0, 999_999), ("f", 5, 3)]
    a = spark.createDataFrame(rows, "k string, s int, e int")
    b = spark.createDataFrame(rows, "k string, s2 int, e2 int")
    got = joins.overlapping_in_blocks(a, b, ["k"], ("s", "e"), ("s2", "e2"), 10, most=3).collect()
    want = [(x, y) for x in rows for y in rows if x[1] <= y[2] and y[1] <= x[2] and x[1] <= x[2] and y[1] <= y[2]]
    assert len(got) == len(want) and {tuple(r)[1:] for r in got} == {(x[1], x[2], y[1], y[2]) for x, y in want}


def test_closures_of_random_hierarchies(spark):
    """First visits against a depth-first walk with one set of visited nodes for all siblings."""
    rng = np.random.default_rng(4)
    edges = sorted({(f"n{a}", f"n{b}") for a, b in rng.integers(0, 14, (26, 2)) if a != b})
    ords, rows = {}, []
    for a, b in edges:
        rows.append((a, b, ords.setdefault(a, 0)))
        ords[a] += 1
    bases = {}
    for a, b, o in rows:
        bases.setdefault(a, []).append(b)

    def walk(node, seen, path, out):
        seen.add(node)
        out[node] = path
        for i, b in enumerate(bases.get(node, [])):
            if b not in seen:
                walk(b, seen, [*path, i], out)
        return out

    got = {(r["node"], r["ancestor"]) for r in _hierarchy(spark, rows).collect()}
    nodes = {x for a, b, _ in rows for x in (a, b)}
    assert got == {(n, a) for n in nodes for a in walk(n, set(), [], {})}


def test_near_duplicates_against_all_pairs(spark):
    import difflib

    rng = np.random.default_rng(6)
    base = ["".join(rng.choice(list("abcdefgh"), 60)) for _ in range(4)]
    texts = [b[:i] + x + b[i:] for b in base for i, x in ((10, "z"), (20, "zzz"), (30, "z" * 9), (5, ""), (7, "zzzzzz"), (9, "z" * 20))]
    rows = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "i int, b string, t string")
    known = spark.createDataFrame([("f", b) for b in base], "b string, t string")
    want = {i for i, t in enumerate(texts) for b in base if difflib.SequenceMatcher(None, t, b).ratio() > 0.9}
    assert 4 < len(want) < 24 and {r["i"] for r in joins.near_duplicates_of(rows, known, "i", "b", "t").collect()} == want


def test_tables_of_a_block_are_deleted(spark, tmp_path):
    from weftline.session import materialize, scratch

    df = spark.range(3)
    with scratch(spark) as outer:
        with scratch(spark) as keep:
            gone, kept = materialize(df, "a"), materialize(df, "b")
            keep(kept)
        from pathlib import Path
        from urllib.parse import urlparse

        there = lambda t: Path(urlparse(t._weftline_folder).path).exists()
        assert kept.count() == 3 and there(kept) and not there(gone)
    assert not there(kept)


def test_empty_tables(spark):
    files = spark.createDataFrame([("b", "f", 0, None), ("b", "g", 1, "no contract")], "bundle string, file string, place int, text string")
    from weftline.operators import hyperedges

    assert hyperedges.hyperedges_of(files).count() == 0 and hyperedges.hyperedges_of(files.limit(0)).count() == 0
    groups = spark.createDataFrame([], "grp int, pos long")
    assert sampling.constrained_search(groups, 5, {("pos", 0): (0, 1)}, [("pos", "pos", 0.5)]).count() == 0
    items = spark.createDataFrame([], "i int, s string, y int, v array<string>")
    assert augment.variants(items, "i", "s", "y", "v").count() == 0
    keyed = spark.createDataFrame([], "file string, k string, bundle long")
    assert joins.resolve_bundle(keyed, keyed, keyed, ["k"]).count() == 0
    scores = spark.createDataFrame([], "y int, s double")
    assert metrics.pr_auc(scores, "y", "s").first()[0] == 0 and metrics.roc_auc(scores, "y", "s").first()[0] == 0
    edits = spark.createDataFrame([("abc", []), (None, []), ("abc", None), ("", [(0, 0, "x")])], "s string, e array<struct<start:int,stop:int,new:string>>")
    assert [r[0] for r in edits.select(text.apply_edits(F.col("s"), F.col("e"))).collect()] == ["abc", None, None, "x"]
