"""Tokens, containers, pieces and abuse scores against brute force and odd input."""

from __future__ import annotations

import base64
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import abuse, bpe, packing, pieces, queries

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    lines = open(P.path("byte_bpe_50k.tiktoken"), "rb").read().split(b"\n")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = [
    "'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\r\n", "\t", "a", "B", "é", "1", "٣", "²", "Ⅷ", "!", ".", " ",
    "　", "​", "\u0085", "\x1c", "é", "漢", "𝒜", "🖕", "<|endoftext|>", " ", "ı", "﻿", "\x00",
]


def test_encoder_agrees_with_another_library(reference):
    rng = random.Random(5)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 16))) for _ in range(8000)]
    texts += ["a" * 5000, " " * 3000, "ab" * 2000 + "'s" * 50, "x"]
    got = bpe.Encoder().encode(texts)
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert all(bpe.decode(i) == t.encode() for i, t in zip(got[:300], texts))


def test_encode_corpus_defined_cases(spark, reference):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "It's  ok\n"), (3, "It's  ok\n"), (4, " ")], "doc_id bigint, text string")
    df = df.withColumn("ids", F.lit("clash"))
    got = sorted((r["doc_id"], list(r["ids"]), list(r["offsets"])) for r in bpe.encode_corpus(df, "doc_id", "text", offsets=True).collect())
    want = reference.encode_ordinary("It's  ok\n")
    assert [g[:2] for g in got] == [(1, []), (2, []), (3, want), (3, want), (4, reference.encode_ordinary(" "))]
    for _, ids, offsets in got:
        assert [len(bpe.decode(ids[:i])) for i in range(len(ids))] == offsets
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    counts = {(r["doc_id"], r["n_tokens"]) for r in bpe.count_tokens(df, "doc_id", "text").collect()}
    assert counts == {(1, 0), (2, 0), (3, len(want)), (4, 1)}
    back = bpe.decode_corpus(bpe.encode_corpus(df, "doc_id", "text", offsets=True), "doc_id").collect()
    assert sorted(map(tuple, back)) == [(1, ""), (2, ""), (3, "It's  ok\n"), (3, "It's  ok\n"), (4, " ")]
    begin = [len(bpe.decode(want[:i])) for i in range(len(want))]
    assert all(bpe.decode(want, begin, a, b) == b"It's  ok\n"[a:b] for a in range(9) for b in range(a, 10))
    assert bpe.decode(want, begin, 3) == b"s  ok\n" and bpe.decode([], []) == b""
    wrong = spark.createDataFrame([(1, want, [0] * len(want))], "doc_id bigint, ids array<int>, offsets array<int>")
    with pytest.raises(Exception, match="do not fit"):
        bpe.decode_corpus(wrong, "doc_id").collect()


def test_p7_on_all_documents(spark, sf, reference):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: list(r["ids"]) for r in queries.p7_ids(spark, sf).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in text.items()}


def test_containers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 400, 3000))] + [(9000, 2048), (9001, 5000), (9002, None), (9003, 0), (7, 3)]
    odd = spark.createDataFrame([(None, 5), (None, 5), (1, -3), (None, None)], "id bigint, n int").withColumn("container_id", F.lit("clash"))
    assert sorted((r["n_tokens"], r["container_id"]) for r in packing.fill_containers(odd, "id", "n").collect() if r["n_tokens"]) == [(5, 0), (5, 0)]
    got = packing.fill_containers(spark.createDataFrame(rows, "id bigint, n int"), "id", "n").collect()
    load, segments = {}, {}
    for r in got:
        if r["container_id"] is not None:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
            segments[r["container_id"]] = segments.get(r["container_id"], 0) + 1
        else:
            assert r["n_tokens"] == 0
    assert max(load.values()) <= 2048 and max(segments.values()) <= 256
    assert sum(load.values()) == sum(n or 0 for _, n in rows)
    assert [(r["piece_no"], r["n_tokens"]) for r in sorted(got, key=lambda r: r["piece_no"]) if r["id"] == 9001] == [(0, 2048), (1, 2048), (2, 904)]
    assert sum(r["id"] == 7 for r in got) == 2 and len(got) == len(rows) + 2
    assert len(load) <= -(-sum(load.values()) // 2048) + 2
    empty = packing.fill_containers(spark.createDataFrame([], "id bigint, n int"), "id", "n")
    assert empty.count() == 0 and packing.fill_report(empty).first()["n_containers"] == 0


def test_all_limits_of_a_container_hold():
    tokens = np.full(1000, 2)
    box = packing.pack_block(tokens, tokens - 1, 2048, 100, 2048)
    assert np.bincount(box).max() == 100
    box = packing.pack_block(tokens, tokens, 2048, 500, 300)
    assert np.bincount(box, tokens).max() <= 300


def test_each_limit_alone_closes_containers(spark):
    rows = [(i, 100, 10) for i in range(60)] + [(100 + i, 500, 0) for i in range(4)] + [(200, 3000, 70), (201, 40, 90), (202, 30, None), (203, 600, 99), (203, 600, 99)]
    df = spark.createDataFrame(rows, "id bigint, n int, loss int")
    for tokens, segments, loss in ((2048, 256, 50), (2048, 3, 2048), (2048, 256, 2048)):
        packed = packing.fill_containers(df, "id", "n", tokens, segments, loss, "loss")
        got = packed.collect()
        assert tuple(packing.limits_report(packed, tokens, segments, loss).first()) == (len(rows), 0, 0, 0, 0, 0)
        assert sum(r["n_tokens"] for r in got) == sum(n for _, n, _ in rows) and all(r["n_pieces"] == 1 for r in got if r["id"] != 200)
        used = len({r["container_id"] for r in got})
        # the limit that binds tells how many containers are needed at the least
        assert used >= {50: 4 + (60 * 10 + 40 + 29) / 50, 2048: 69 / segments}[loss] and used <= {3: 26, 256: 19}[segments]
        shuffled = packing.fill_containers(df.repartition(5, "n"), "id", "n", tokens, segments, loss, "loss").collect()
        assert Counter(map(tuple, shuffled)) == Counter(map(tuple, got))


def test_tokens_within_quoted_code_bear_no_loss(spark, reference):
    texts = ["plain text", "See ```a b c``` now", "```é ö```", "open ```rest of it", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r["id"]: (r["n_tokens"], r["n_loss"]) for r in bpe.count_tokens(df, "id", "t", queries.QUOTED).collect()}
    assert got[0] == (2, 1) and got[2][1] == 0 and got[4] == got[5] == (0, 0)
    ids = reference.encode_ordinary(texts[1])
    begin = np.cumsum([0] + [len(reference.decode_single_token_bytes(i)) for i in ids])[:-1]
    assert got[1] == (len(ids), int(((begin[1:] < 4) | (begin[1:] >= 15)).sum()))
    assert got[3][1] < got[3][0] - 2


@pytest.mark.parametrize("limit, overlap", [(1200, 120), (40, 5), (30, 0)])
def test_pieces(spark, limit, overlap):
    code = "function f() {\r\n    a = 1; // 𝒜\n    if (b) {\n        c();\n    }\n\n}\n" * 60
    texts = [None, "", "x", "y" * 1200, "y" * 1201, code, "𝒜" * 2500, "word " * 700, "\n" * 3000, "a;\n" * 2, code, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("piece_no", F.lit("clash"))
    parts: dict[int, list] = {}
    for r in pieces.split_oversized(df, "id", "t", limit, overlap).collect():
        parts.setdefault(r["id"], []).append(r)
    for i, text in enumerate(texts):
        own = sorted(parts[i], key=lambda r: r["piece_no"])
        if text is None:
            assert [tuple(r)[1:] for r in own] == [(0, 0, 0, None)]
            continue
        assert "".join(r["piece"][r["overlap"]:] for r in own) == text
        assert all(len(r["piece"]) <= limit and r["n_pieces"] == len(own) for r in own)
        assert (len(own) > 1) == (len(text) > limit)
        for a, b in zip(own, own[1:]):
            assert b["overlap"] <= overlap and a["piece"].endswith(b["piece"][: b["overlap"]])
            assert b["overlap"] >= min(overlap // 2, len(a["piece"]) - a["overlap"])
            assert not (a["piece"].endswith("\r") and b["piece"][b["overlap"]:].startswith("\n"))
        if text is code and limit == 1200:
            assert all(r["piece"].rstrip("\r\n")[-1] in "};" for r in own)
    with pytest.raises(ValueError):
        pieces.pieces_of(F.col("t"), 100, 100)


def test_disguises_of_words_are_undone():
    words = lambda t: [w for p in abuse.passages(t) for w in p]
    assert words("you i­d​i‍ot") == ["you", "idiot"]
    assert words("s.c.u.m.b.a.g!!") == ["scumbag"]
    assert words("bаstаrd ASSH0LE $tupid") == ["bastard", "asshole", "stupid"]
    assert words("you iDiot, _idiot_ __idiot") == ["you", "idiot", "idiot", "idiot"]
    assert words("_dailyLimit IVaultToken Router.sol toFee") == ["xid", "xid", "xid", "tofee"]
    assert abuse.passages(None) == [] and abuse.passages(" \n ") == []


def test_words_are_summed_once_and_scored_as_bags():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=abuse.BUCKETS + 1).astype(np.float32)
    parts = [abuse.passages(t)[0] for t in ("You are so slow", "the slow pool drains", "slow", "You are so slow")]
    feat, own = abuse.bags(parts)
    size = np.bincount(own, minlength=4)
    want = 1 / (1 + np.exp(-np.bincount(own, weights[:-1][feat], 4) / (size + abuse.SHRINK) - weights[-1]))
    scorer = abuse.Scorer(weights)
    assert np.allclose(scorer.scores(parts[:2]), want[:2]) and np.allclose(scorer.scores(parts), want)


def test_scorer_on_held_out_texts(spark):
    rng = random.Random(0)
    clean = ["The guard on {} covers deposits.", "Please add a test for {}.", "Interest on {} is charged late.", "The style guide forbids rude words in {}."]
    bad = ["You are a worthless {} and nobody wants you.", "Only a pathetic {} would ship this.", "Shut up, you {}."]
    insults = ["idiot", "moron", "imbecile", "bastard"]
    name = lambda: "".join(rng.choice("aeiou") + rng.choice("bdfgkl") for _ in range(3))

    def text(abusive):
        parts = [rng.choice(clean).format(name()) for _ in range(rng.randint(1, 6))]
        if abusive:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(bad).format(rng.choice(insults)))
        return " ".join(parts)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(700)]
    labels = spark.createDataFrame([(i, y if rng.random() > 0.03 else 1 - y, "j") for i, _, y in rows[:500]] + [(99999, 1, "j"), (3, None, "j")], "doc_id bigint, abusive int, judge string")
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(5000, None, None), (5001, "", "s"), (5002, "you are a worthless im​bec!le", "s")], "doc_id bigint, text string, source string")
    weights = abuse.fit_scorer(docs, labels)
    got = {r["doc_id"]: r["score"] for r in abuse.score_texts(docs, weights, "doc_id", "text", "source").collect()}
    assert len(got) == 703 and got[5000] == 0 and got[5001] == 0
    right = [(got[i] >= queries.ABUSE_AT) == bool(y) for i, _, y in rows[500:]]
    assert np.mean(right) > 0.95
    none = abuse.fit_scorer(docs, labels.limit(0))
    assert max(r["score"] for r in abuse.score_texts(docs, none, "doc_id", "text").collect()) < 0.1
