"""Copies, groups, splits, overlaps and samples against brute force and odd input."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import canonical, fulltext, neardup, overlap, queries, records, related_splits, shingles, target_sample

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("forge_constructable_hyperedges", "forge_hyperedge_examples", "sample_targets", "documents", "split_items"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = queries.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


SOURCES = [
    (1, "function a() { x = S({kind: 1, owner: f(a, b)}); }"), (2, "FUNCTION a(){x=S({ owner : f(a,b) ,kind:1 });}"), (3, "function a() { x = S({kind: 2, owner: f(a, b)}); }"),
    (4, None), (5, "  \n"), (6, ""), (7, "!!!"), (8, "???"), (9, "function a() { x = S({kind: 1, owner: f(a, b)}); }"), (10, " "), (11, "a" * 300_000), (12, "A" * 300_000),
]


def test_copies(spark):
    df = spark.createDataFrame(SOURCES, "id bigint, t string").withColumn("h", F.lit("clash"))
    sig = canonical.copy_signatures(df, "id", "t")
    assert {tuple(r) for r in canonical.copy_pairs(sig).collect()} == {(1, 2), (1, 9), (7, 8), (11, 12)}
    assert {(r["kept_id"], r["n_copies"]) for r in canonical.collapse_copies(sig).collect()} == {(1, 3), (3, 1), (7, 2), (11, 2)}
    assert canonical.hash_clashes(sig).first()["n_clashes"] == 0
    none = canonical.copy_signatures(df.limit(0), "id", "t")
    assert canonical.copy_pairs(none).count() == 0 and canonical.hash_clashes(none).first()["n_hashes"] == 0


NESTED = [
    (1, "({a: f(x, h(1)), b: k(y, g(2))})"), (2, "({a: f(x, g(2)), b: k(y, h(1))})"), (3, "({ b: K(y, g(2)), a: f(x,h(1)) })"),
    (4, "S({a: T({x: 1, y: 2}), b: [1, 2]})"), (5, "s({b: [1,2], a: t({y: 2, x: 1})})"), (6, "S({a: T({x: 2, y: 1}), b: [1, 2]})"),
    (7, "f({a: 1, b: 2"), (8, "f({b: 2, a: 1"), (9, "F ( { A:1 , b : 2"), (10, "x({a: m[i], b: g(1)}) y({d, c})"), (11, "x({b: g(1), a: m[i]}) y({c, d})"),
    (12, "y({d, c}) x({a: m[i], b: g(1)})"), (13, "g(function() { x, y; })"), (14, "g(function() { y, x; })"), (15, "({a: 'é', b: 漢})"), (16, "({b: 漢, a: É})"),
]


def test_copies_with_brackets_in_fields(spark):
    """Hand-worked: commas part fields only where no bracket of the literal is open."""
    sig = canonical.copy_signatures(spark.createDataFrame(NESTED, "id bigint, t string"), "id", "t")
    assert {tuple(r) for r in canonical.copy_pairs(sig).collect()} == {(1, 3), (4, 5), (7, 9), (10, 11), (15, 16)}


@pytest.mark.parametrize("name", ["p4_found", "p4_records"])
def test_sql_of_copies_follows_the_same_rule(name):
    con = duckdb.connect()
    flat = [x for x in NESTED if x[0] not in (4, 5, 6)]  # SQL has no nested literals
    con.execute("create table forge_hyperedge_examples(example_id bigint, function_source varchar)")
    con.executemany("insert into forge_hyperedge_examples values (?, ?)", flat)
    got = con.execute(queries.oracle_sql()[name]).fetchall()
    assert {tuple(r) for r in got if name == "p4_found" or r[1] > 1} == ({(1, 3), (7, 9), (10, 11), (15, 16)} if name == "p4_found" else {(1, 2), (7, 2), (10, 2), (15, 2)})


def brute_groups(rows, threshold, k):
    plain = lambda t: "".join(c for c in t.lower() if c.isalnum())
    fields = lambda m: "".join(sorted(plain(x) for x in re.split(r",(?![^(]*\))", m.group(1))))
    own = {i: t for i, t in rows if t and t.strip()}
    parent = {i: i for i in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    key = {i: plain(re.sub(r"\(\s*\{([^{}]*)\}\s*\)", fields, t)) for i, t in own.items()}
    words = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in own.items()}
    runs = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for i, w in words.items()}
    for a, b in combinations(own, 2):
        union = len(runs[a] | runs[b])
        if key[a] == key[b] or (union and len(runs[a] & runs[b]) / union >= threshold):
            parent[root(a)] = root(b)
    groups = defaultdict(set)
    for i in own:
        groups[root(i)].add(i)
    return {frozenset(g) for g in groups.values()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.integers(len(words))
        words[at : at + 1] = [["new%d" % rng.integers(10**6)], [], [words[at], "in%d" % rng.integers(10**6)]][rng.integers(3)]
    return words


@pytest.mark.parametrize("threshold, k", [(0.6, 3), (0.8, 5)])
def test_groups_against_all_pairs(spark, threshold, k):
    rng = np.random.default_rng(11)
    rows = list(SOURCES[:10])
    for family in range(25):
        words = ["w%d" % x for x in rng.integers(0, 4000, rng.integers(20, 120))]
        for _ in range(rng.integers(1, 9)):
            rows.append((len(rows) + 100, " ".join(edited(rng, words, rng.integers(0, 9)))))
    rows += [(9000, "two words"), (9001, "Two  words!"), (9002, "one"), (9003, "漢字 かな a_b 𝒜x " * 9), (9004, "漢字 かな a b 𝒜X " * 9)]
    tokens = shingles.tokenized(spark.createDataFrame(rows, "id bigint, t string").repartition(3), "id", "t")
    got = defaultdict(set)
    for r in neardup.near_duplicate_groups(tokens, threshold, k).collect():
        got[r["grp"]].add(r["id"])
    assert {frozenset(g) for g in got.values()} == brute_groups(rows, threshold, k)


def test_groups_of_a_hot_family(spark):
    """A third of all texts are edits of one, copies among them; no pair of all is formed."""
    rng = np.random.default_rng(2)
    base = ["h%d" % x for x in rng.integers(0, 9999, 80)]
    rows = [(i, " ".join(edited(rng, base, rng.integers(0, 6)))) for i in range(700)]
    rows += [(10_000 + i, " ".join("z%d" % x for x in rng.integers(0, 10**7, 60))) for i in range(1400)]
    tokens = shingles.tokenized(spark.createDataFrame(rows, "id bigint, t string").repartition(4), "id", "t")
    got = defaultdict(set)
    for r in neardup.near_duplicate_groups(tokens, 0.6, 3).collect():
        got[r["grp"]].add(r["id"])
    assert Counter(map(len, got.values())) == {700: 1, 1: 1400}
    pairs = neardup.forest_candidates(tokens, 0.6, 3).count()
    assert pairs < 700 * 699 / 2 * 0.6


def boilerplate_family(rng, n):
    """Texts that share boilerplate at 0.5 to 0.59; every second one is at little above 0.6 to the one before."""
    base = ["b%d" % i for i in range(72)]
    rows = []
    for i in range(n):
        own = ["o%d" % x for x in rng.integers(0, 10**8, 28)]
        if i % 2:
            own[:5] = rows[-1].split()[72:77]
        rows.append(" ".join(base + own))
    return rows


def all_links(texts, threshold, k):
    """Pairs of positions at the threshold, by the runs that at least two texts have."""
    runs = [{tuple(w[j : j + k]) for j in range(len(w) - k + 1)} for w in map(str.split, texts)]
    number = {r: i for i, r in enumerate(r for r, n in Counter(r for x in runs for r in x).items() if n > 1)}
    has = np.zeros((len(texts), len(number)), np.float32)
    for i, x in enumerate(runs):
        has[i, [number[r] for r in x if r in number]] = 1
    both, size = has @ has.T, np.array([len(x) for x in runs])
    a, b = np.nonzero(np.triu(both / np.maximum(size[:, None] + size[None, :] - both, 1) >= threshold - 1e-6, 1))
    return {(int(x), int(y)) for x, y in zip(a, b)}


def family_tokens(spark, texts, others, rng):
    rows = list(enumerate(texts)) + [(10_000 + i, " ".join("z%d" % x for x in rng.integers(0, 10**7, 60))) for i in range(others)]
    return shingles.tokenized(spark.createDataFrame(rows, "id bigint, t string").repartition(4), "id", "t")


def test_no_link_is_lost_where_a_block_sends_few_labels(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 2)
    rng = np.random.default_rng(8)
    texts = boilerplate_family(rng, 300)
    assert all_links(texts, 0.6, 3) == {(i, i + 1) for i in range(0, 300, 2)}
    got = {(r["id"], r["grp"]) for r in neardup.near_duplicate_groups(family_tokens(spark, texts, 600, rng), 0.6, 3).collect()}
    size = Counter(g for _, g in got)
    group = dict(got)
    assert Counter(size.values()) == {2: 150, 1: 600} and all(group[i] == group[i + 1] for i in range(0, 300, 2))


@pytest.mark.parametrize("hot, meetings", [(200_000, 2_000_000), (3, 50)])
def test_missed_pairs_are_all_pairs(spark, monkeypatch, hot, meetings):
    monkeypatch.setattr(neardup, "HOT_RUN", hot)
    monkeypatch.setattr(neardup, "MEETINGS", meetings)
    rng = np.random.default_rng(9)
    texts = boilerplate_family(rng, 60)
    for family in range(12):
        words = ["w%d" % x for x in rng.integers(0, 300, rng.integers(3, 90))]
        texts += [" ".join(edited(rng, words, rng.integers(0, 9))) for _ in range(8)]
    texts = list(dict.fromkeys(texts))
    tokens = family_tokens(spark, texts, 0, rng)
    key = {r["w"]: r["id"] for r in tokens.select("w", "id").collect()}
    none = spark.createDataFrame([], "node bigint, component bigint")
    links = neardup.verified(neardup.missed_pairs(tokens, none, 0.6, 3), tokens, 0.6, 3).collect()
    want = all_links(texts, 0.6, 3)
    assert len(want) > 80 and {tuple(sorted((key[r["a"]], key[r["b"]]))) for r in links} == want
    known = neardup.connected_components(spark.createDataFrame(links))
    assert neardup.verified(neardup.missed_pairs(tokens, known, 0.6, 3), tokens, 0.6, 3).count() == 0


def test_no_groups_in_an_empty_table(spark):
    tokens = shingles.tokenized(spark.createDataFrame([(1, None)], "id bigint, t string"), "id", "t")
    assert neardup.near_duplicate_groups(tokens).count() == 0


def test_depth_is_shortened_until_the_recall_is_met():
    d = neardup.depth_for(0.6, 48, 0.998)
    assert 1 - (1 - 0.6**d) ** 48 >= 0.998 > 1 - (1 - 0.6 ** (d + 1)) ** 48
    assert neardup.depth_for(0.1, 2, 0.999) == 1


def test_full_text_index():
    rng = np.random.default_rng(0)
    symbols = np.array([5, 2**31 - 1, 2**31 + 5, 2**32 - 1, 77], np.uint32)
    flat = lambda texts: (np.concatenate(texts), np.cumsum([0] + [len(x) for x in texts]))
    for _ in range(25):
        texts = [symbols[rng.integers(0, 4, rng.integers(1, 25))] for _ in range(rng.integers(1, 12))]
        index = fulltext.build_index(np.arange(len(texts)), *flat(texts))
        index = fulltext.read_index(fulltext.write_rows(0, index).to_dict("records"))
        patterns = [symbols[rng.integers(0, 5, rng.integers(1, 30))] for _ in range(8)]
        got = defaultdict(list)
        for p, start, length, low, high in zip(*fulltext.backward_matches(index, *flat(patterns), 1)):
            got[p].append((start, length, sorted(index.text[low:high])))
        for i, p in enumerate(patterns):
            stands = lambda q: [d for d, x in enumerate(texts) for o in range(len(x) - len(q) + 1) if (x[o : o + len(q)] == q).all()]
            want, end = [], len(p)
            while end > 0:
                n = 0
                while n < end and stands(p[end - n - 1 : end]):
                    n += 1
                if n:
                    want.append((end - n, n, sorted(stands(p[end - n : end]))))
                end -= max(n, 1)
            assert sorted(got[i]) == sorted(want)


def test_every_maximal_match(monkeypatch):
    monkeypatch.setattr(fulltext, "FOUND_WINDOWS", 20)
    rng = np.random.default_rng(3)
    flat = lambda texts: (np.concatenate(texts), np.cumsum([0] + [len(x) for x in texts]))
    for least in (1, 3, 4) * 8:
        texts, patterns = ([rng.integers(2, 5, rng.integers(1, 25)).astype(np.uint32) for _ in range(n)] for n in (8, 6))
        index = fulltext.build_index(np.arange(len(texts)), *flat(texts))
        index = fulltext.read_index(fulltext.write_rows(0, index).to_dict("records"))
        got, merged = [], {}
        for found in fulltext.maximal_matches(index, *flat(patterns), least):
            got += zip(*(x.tolist() for x in found))
            merged |= {(p, t): tuple(rest) for p, t, *rest in zip(*(x.tolist() for x in fulltext.merge_spans(len(texts), *found)))}
        want = []
        for i, p in enumerate(patterns):
            for j, t in enumerate(texts):
                for a in range(len(p)):
                    for b in range(len(t)):
                        if a and b and p[a - 1] == t[b - 1]:
                            continue
                        n = 0
                        while a + n < len(p) and b + n < len(t) and p[a + n] == t[b + n]:
                            n += 1
                        if n >= least:
                            want.append((i, j, a, n))
        assert sorted(got) == sorted(want)
        cover, most = defaultdict(set), defaultdict(int)
        for i, j, a, n in want:
            cover[i, j] |= set(range(a, a + n))
            most[i, j] = max(most[i, j], n)
        assert {k: v[1:] for k, v in merged.items()} == {k: (len(v), most[k]) for k, v in cover.items()}


def test_a_copy_hides_no_other_match(spark):
    code = lambda w: np.array(w, np.uint32).tobytes()
    text = list(range(100, 140))
    rows = [(1, code(text), True), (2, code(text), False), (3, code([*text[:30], 7, *text[31:]]), False), (4, code([*text[:14], 7, *text[14:26], 8]), False)]
    sides = spark.createDataFrame(rows, "key bigint, tokens binary, is_train boolean")
    got = {tuple(r) for r in fulltext.cross_matches(sides, 12).collect()}
    assert got == {(1, 2, 1, 40, 40), (1, 3, 1, 30, 30), (1, 4, 2, 26, 14)}


def test_fingerprints_lose_no_shared_run():
    rng = np.random.default_rng(6)
    for _ in range(200):
        shared = rng.integers(2, 50, 12)
        a, b = (np.r_[rng.integers(2, 50, rng.integers(0, 30)), shared, rng.integers(2, 50, rng.integers(0, 30))].astype(np.uint32) for _ in "ab")
        fp, owner = fulltext.fingerprints(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]), 12)
        assert set(fp[owner == 0]) & set(fp[owner == 1])
    assert len(fulltext.fingerprints(np.arange(8, dtype=np.uint32), np.array([0, 8]), 12)[0]) == 0


def test_matches_across_sides(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "SHARD_SYMBOLS", 40)
    code = lambda *w: np.array(w, np.uint32).tobytes()
    run = tuple(range(100, 120))
    rows = [(1, code(*run, 5, 6), True), (2, code(7, *run[:15]), False), (3, code(*range(500, 540)), False), (4, code(*range(900, 960)), True), (1, code(*run, 5, 6), True), (5, None, True)]
    sides = spark.createDataFrame(rows, "key bigint, tokens binary, is_train boolean")
    assert [tuple(r) for r in fulltext.cross_matches(sides, 12).collect()] == [(1, 2, 1, 15, 15)]
    assert fulltext.cross_matches(sides.where("is_train"), 12).count() == 0


def test_overlaps_against_groups(spark):
    """Pairs across splits are those of the groups, also through texts of no split."""
    rng = np.random.default_rng(4)
    base = ["k%d" % x for x in rng.integers(0, 9999, 90)]
    a, b, c = base, base[:45] + ["x%d" % i for i in range(9)] + base[54:], base[:9] + ["y%d" % i for i in range(9)] + base[18:45] + ["x%d" % i for i in range(9)] + base[54:]
    rows = [(1, 11, " ".join(a)), (2, 12, " ".join(b)), (3, 13, " ".join(c)), (4, 14, "nothing like the others at all"), (5, None, " ".join(a)), (6, 16, None)]
    splits = spark.createDataFrame([(11, " Train", 1, "s"), (12, None, 1, "s"), (13, "VAL ", 1, "t"), (14, "test", 1, None), (16, "train", 1, "s")], "hyperedge_id bigint, split string, label int, source string")
    sides = overlap.split_sides(splits)
    tokens = shingles.tokenized(spark.createDataFrame(rows, "id bigint, hyperedge_id bigint, t string"), "id", "t", "hyperedge_id")
    assert {tuple(r)[:2] for r in overlap.source_pairs(tokens, sides, 0.6, 3).collect()} == {(1, 3)}
    names = spark.createDataFrame([(11, "src\\A.sol#L3", "A.go(uint256 a)"), (13, "/x/a.SOL ", " function GO"), (14, "N/A", "go"), (16, None, "go"), (14, "a.sol", "A::stop")], "hyperedge_id bigint, file string, function string")
    assert [tuple(r)[:2] for r in overlap.name_pairs(names, sides).collect()] == [(11, 13)]


def test_matches_of_pairs_by_both_sources(spark):
    words = ["k%d" % i for i in range(60)]
    rows = [(1, 11, " ".join(words)), (2, 12, " ".join([*words[:30], "new", *words[31:]])), (3, 13, "a b c d"), (4, 14, "A b c d")]
    splits = spark.createDataFrame([(11, "train", 1, "s"), (12, "val", 1, "t"), (13, "train", 1, "u"), (14, "test", 1, None)], "hyperedge_id bigint, split string, label int, source string")
    sides = overlap.split_sides(splits)
    tokens = shingles.tokenized(spark.createDataFrame(rows, "id bigint, hyperedge_id bigint, t string"), "id", "t", "hyperedge_id")
    pairs = overlap.source_matches(tokens, sides, 0.6, 3)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2, 1, 2, 2, 59, 30), (3, 4, 3, 4, 0, 0, 0)}


def test_direct_pairs_come_from_the_index(spark, monkeypatch):
    """Without forest and inverted index every pair across the sides that is alike by itself is still found."""
    rng = np.random.default_rng(12)
    rows = []
    for family in range(40):
        words = ["w%d" % x for x in rng.integers(0, 10**6, rng.integers(50, 120))]
        rows += [(len(rows) + j, len(rows) + j, " ".join(edited(rng, words, rng.integers(0, 7)))) for j in range(3)]
    side = {i: ["train", "val", "test", None][rng.integers(4)] for i, _, _ in rows}
    splits = spark.createDataFrame([(i, s, 1, "s") for i, s in side.items()], "hyperedge_id bigint, split string, label int, source string")
    tokens = shingles.tokenized(spark.createDataFrame(rows, "id bigint, hyperedge_id bigint, t string"), "id", "t", "hyperedge_id")
    none = spark.createDataFrame([], "a bigint, b bigint")
    monkeypatch.setattr(neardup, "forest_candidates", lambda *_: none)
    monkeypatch.setattr(neardup, "missed_pairs", lambda *_: none)
    got = {(r["id_a"], r["id_b"]) for r in overlap.source_pairs(tokens, overlap.split_sides(splits), 0.6, 3).collect()}
    links = all_links([t for _, _, t in rows], 0.6, 3)
    want = {(a, b) for a, b in links if None not in (side[a], side[b]) and (side[a] == "train") != (side[b] == "train")}
    assert len(want) > 20 and want <= got


def test_prefixes_are_shortened_while_subtrees_stay_small():
    byte = lambda *levels: sum(x << (56 - 8 * i) for i, x in enumerate(levels))
    label = [byte(1, 1, i) for i in range(3)] + [byte(2, i // 2, i % 2) for i in range(20)] + [byte(1, 1, 0)]
    tree = np.array([0] * 23 + [1], np.uint16)
    got = {tuple(x) for x in neardup.trie_pairs(tree, np.array(label, np.uint64), np.arange(24), 1).tolist()}
    small = {(a, b) for a, b in combinations(range(3), 2)}
    # a subtree of twenty is not paired as a whole: its children are, and neighbours
    assert got == small | {(i, i + 1) for i in range(3, 22)}
    assert len(neardup.trie_pairs(tree[:1], np.zeros(1, np.uint64), np.zeros(1, np.int64), 1)) == 0


def test_report_by_both_sources(spark, sf):
    by_eval, by_both = Counter(), Counter()
    for r in queries.p5_report(spark, sf).collect():
        by_eval[r["kind"], r["split"], r["source"]] += r["n_pairs"]
    for r in queries.p5_sources(spark, sf).collect():
        by_both[r["kind"], r["split"], r["source"]] += r["n_pairs"]
        assert (r["spans"] is None) == (r["kind"] == "name") and (r["covered"] or 0) >= (r["longest"] or 0)
    assert by_eval == by_both and by_both


@pytest.mark.parametrize("given, want", [
    ("src\\v\\A.sol", "a.sol"), ("./x/A.SOL#L3-L9", "a.sol"), ("\tA.sol ", "a.sol"), ("N/A", None), ("unknown", None), ("  ", None), ("-", None), (None, None),
])
def test_file_names(spark, given, want):
    assert spark.createDataFrame([(given,)], "x string").select(records.file_name(F.col("x"))).first()[0] == want


@pytest.mark.parametrize("given, want", [("High Risk", "High"), ("severity: LOW", "Low"), ("med.", "Medium"), ("Crit", "Critical"), ("INFO", "Informational"), ("TBD", None), ("", None), (None, None)])
def test_grades(spark, given, want):
    assert spark.createDataFrame([(given,)], "x string").select(records.grade(F.col("x"))).first()[0] == want


def test_units_and_splits(spark):
    rng = np.random.default_rng(7)
    rows = [(i, f"vfp_{int(b):05d}" if b else None, f"F{int(f)}.sol" if f else "N/A", "High" if rng.random() < 0.3 else None, None) for i, (b, f) in enumerate(zip(np.minimum(rng.zipf(1.4, 4000), 3000), rng.integers(0, 10**6, 4000)))]
    rows += [(9000, None, None, "Low", None), (9001, None, "F7.sol", "Low", None), (9001, None, "F7.sol", "Low", None)]
    df = spark.createDataFrame(rows, "hyperedge_id bigint, vfp_id string, file string, severity string, ingested_at timestamp").withColumn("unit", F.lit("clash"))
    units = related_splits.hyperedge_units(df)
    got = related_splits.swap_search_splits(units, "severity").collect()
    assert len(got) == 4002 and {r["split"] for r in got} <= {"train", "val", "test"}
    place = {}
    for r in got:
        for kind, key in (("b", r["bundle"]), ("f", r["file"])):
            if key is not None:
                assert place.setdefault((kind, key), r["split"]) == r["split"]
    n = Counter(r["split"] for r in got)
    assert abs(n["train"] / 4002 - 0.7) < 0.02 and abs(n["val"] / 4002 - 0.15) < 0.02
    assert related_splits.swap_search_splits(related_splits.hyperedge_units(df.limit(0)), "severity").count() == 0


def test_splits_of_many_shards(spark, monkeypatch):
    """A component larger than a shard is made up for by the others in further turns."""
    monkeypatch.setattr(related_splits, "SHARD_UNITS", 60)
    rng = np.random.default_rng(15)
    rows = [(f"u{u}", "a" if rng.random() < 0.2 else "b") for u in np.minimum(rng.zipf(1.3, 6000), 900)]
    df = spark.createDataFrame(rows, "unit string, label string").withColumn("split", F.lit("clash"))
    got = related_splits.swap_search_splits(df, "label", steps=2000).collect()
    assert len(got) == 6000 and all(len({r["split"] for r in got if r["unit"] == u}) == 1 for u in ("u1", "u2", "u900"))
    report = related_splits.split_report(spark.createDataFrame(got), "label", queries.NAMES, queries.SHARES).collect()
    assert {r["label"] for r in report} == {None, "a", "b"} and sum(r["n"] for r in report) == 12000
    assert max(abs(r["share"] - r["wanted"]) for r in report) < 0.02


def test_search_improves_on_its_start():
    rng = np.random.default_rng(1)
    sizes = np.c_[rng.integers(1, 300, 200), rng.integers(0, 30, 200)].astype(float)
    shares = np.array([0.7, 0.15, 0.15])
    start = rng.integers(0, 3, 200)
    first, _ = related_splits._search(sizes, shares, start, 0, 0)
    last, place = related_splits._search(sizes, shares, start, 0, 8000)
    assert last < first / 20
    total = np.zeros((3, 2))
    np.add.at(total, place, sizes)
    assert np.abs(total[:, 0] / total[:, 0].sum() - shares).max() < 0.01


def test_search_of_many_units_is_as_fine():
    rng = np.random.default_rng(5)
    size = np.maximum(1, 3000 / np.arange(1, 12_289) ** 0.8).astype(int)
    sizes = np.c_[size, rng.binomial(size, 0.2)].astype(float)
    cost, place = related_splits._search(sizes, np.array([0.7, 0.15, 0.15]), rng.integers(0, 3, len(size)), 0, 20_000)
    assert cost < 0.001 and len(place) == len(size)


def test_counts_are_repaired():
    have, target, floor = np.array([1000, 500, 5, 300]), np.array([0.2, 0.3, 0.1, 0.4]), np.array([3, 3, 3, 3])
    n = target_sample.repair_counts(have, target, floor, 200)
    assert n.sum() == 200 and (n <= have).all() and (n >= np.minimum(have, floor)).all()
    assert n[2] == 5 and abs(n[:2] - [40, 60]).sum() + abs(n[3] - 80) == 15
    assert target_sample.repair_counts(np.array([2, 2]), np.array([0.5, 0.5]), np.array([5, 5]), 100).tolist() == [2, 2]
    assert target_sample.repair_counts(np.array([9, 9]), np.array([0.5, 0.5]), np.array([9, 9]), 4).sum() == 4


def test_counts_of_any_size_are_repaired_alike():
    for scale in (1, 10**6, 10**9):
        have = np.array([700, 250, 20, 30]) * scale
        n = target_sample.repair_counts(have, np.array([0.25, 0.25, 0.25, 0.25]), np.array([5, 5, 5, 5]), 100 * scale)
        assert n.sum() == 100 * scale and (n <= have).all() and n[2] == 20 * scale and abs(n[3] - 25 * scale) <= 1


def test_every_target_called_met_is_drawn():
    rng = np.random.default_rng(14)
    for _ in range(60):
        have, share = rng.integers(0, 400, 12), rng.dirichlet(np.ones(12))
        floor, size = rng.integers(0, 4, 12), int(have.sum()) // 10
        n = target_sample.repair_counts(have, share, floor, size)
        met = target_sample.targets_met(have, share, floor, size)
        assert (n[met] >= np.maximum(floor, np.floor(share * size) - 1)[met]).all() and (n[~met] == have[~met]).all()


def test_sample_meets_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [None, "a", "b", "c"][int(k)]) for i, k in enumerate(rng.choice(4, 5000, p=[0.05, 0.8, 0.14, 0.01]))]
    have = Counter(k for _, k in rows)
    df = spark.createDataFrame(rows, "id bigint, k string").withColumn("n", F.lit("clash"))
    targets = spark.createDataFrame([(1, "a", 0.4, 2), (2, "b", 0.4, 2), (3, "c", 0.2, 2), (4, "d", 0.0, 1)], "target_id int, k string, target_share double, min_rows int")
    sample, report = target_sample.sample_to_targets(df, targets, "id", "k")
    got = sample.collect()
    assert len(got) == len({r["id"] for r in got}) == 500
    drawn = Counter(r["k"] for r in got)
    assert drawn["c"] == have["c"] and drawn["a"] >= 200 and drawn["b"] >= 200
    assert {r["target_id"]: r["met"] for r in report.collect()} == {1: True, 2: True, 3: have["c"] >= 100, 4: False}
    assert {r["target_id"]: r["drawn"] for r in report.collect()} == {i: drawn[k] for i, k in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))}
    empty, said = target_sample.sample_to_targets(df.limit(0), targets, "id", "k")
    assert empty.count() == 0 and not any(r["met"] for r in said.where("wanted > 0").collect())


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() >= 0


def test_recall_where_a_third_shares_boilerplate(spark):
    """A subtree far above SMALL_SUBTREE, in which links stand at any distance in trie order."""
    rng = np.random.default_rng(10)
    texts = boilerplate_family(rng, 1000)
    links = neardup.near_duplicate_links(family_tokens(spark, texts, 2000, rng), 0.6, 3)
    assert links.distinct().count() == len(all_links(texts, 0.6, 3)) == 500
