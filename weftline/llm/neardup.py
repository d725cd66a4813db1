"""Near-duplicate records with small edits (problem 2): MinHash LSH forest.

Every text has a label in each tree of a forest, one byte of a MinHash value for each of eight levels.
Sorting labels gives the leaves of a prefix trie in order. The prefix that two texts must share is
shortened from the deepest level on, for each subtree by itself: as long as it stays small, and no
further than where the chance to meet a pair at the threshold in some tree reaches the target recall.
What then shares a subtree becomes a candidate, whose similarity is computed from all runs of words.

In a subtree that is still large at the depth of the target recall the forest meets only part of the
pairs. These, and the few it misses elsewhere, are found by an inverted index on the rarest runs of
each text, which looks at pairs between groups only and loses none that can reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shingles import flat, mix, runs
from weftline.operators.components import connected_components, star_edges
from weftline.session import materialize, scratch

DEEPEST = 8
#: Texts of one task's block, whose labels are made and sent together.
BLOCK_TEXTS = 4_000
#: Labels sorted in one task on average.
PART_LABELS = 2_000_000
#: A subtree with more members within one block sends only so many of them on, spread over the trie;
#: all its members are paired within the block.
BLOCK_MEMBERS = 16
#: A prefix is shortened while its subtree has at most so many members, which all become candidates of
#: each other (a constant number a text); larger subtrees give neighbours in trie order.
SMALL_SUBTREE = 8
#: One candidate in so many is verified first.
FIRST_PART = 8
SEED = 99
#: Rows are counted by the upper bits of their runs; the table has 4 bytes an entry in each task.
COUNT_BITS, COUNT_SLICES = 20, 16
#: Postings met in one task on average, and pairs of them formed at a time.
PART_POSTINGS, MEETINGS = 2_000_000, 2_000_000
#: Runs of more rows than this are met in several tasks.
HOT_RUN = 200_000
#: Bounds are let go by so much, so that rounding loses no pair.
SLACK = 1e-6


def depth_for(threshold: float, trees: int, recall: float) -> int:
    """The longest label prefix with which ``trees`` trees find a pair at ``threshold`` with
    probability ``recall``; shortened from the deepest level."""
    for depth in range(DEEPEST, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def labels(tokens: np.ndarray, bounds: np.ndarray, trees: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labels (texts x trees) of the texts that have a run of ``k`` words, and which these are.

    A label has a byte for each of DEEPEST levels, the first one highest, each of an own MinHash
    value, so that sorting labels visits the trie in order.
    """
    x, owner = runs(tokens, bounds, k)
    texts, first = np.unique(owner, return_index=True)
    if not len(texts):
        return np.zeros((0, trees), np.uint64), texts
    rng = np.random.default_rng(SEED)
    mul = rng.integers(0, 1 << 31, trees * DEEPEST, np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, trees * DEEPEST, np.uint32)
    out = np.zeros((trees, len(texts)), np.uint64)
    x = (x >> np.uint64(32)).astype(np.uint32)  # half the bits are enough to order runs, at half the cost
    buffer = np.empty_like(x)
    for j in range(len(mul)):
        np.multiply(x, mul[j], out=buffer)
        np.add(buffer, add[j], out=buffer)
        level = mix(np.minimum.reduceat(buffer, first).astype(np.uint64) + np.uint64(j << 32)) >> np.uint64(56)
        out[j // DEEPEST] |= level << np.uint64(56 - 8 * (j % DEEPEST))
    return np.ascontiguousarray(out.T), texts


def shared_levels(tree: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How many levels each label but the first shares with the one before it; -1 in another tree."""
    apart = label[1:] ^ label[:-1]
    shared = np.zeros(len(apart), np.int8)
    for d in range(1, DEEPEST + 1):
        shared += apart >> np.uint64(64 - 8 * d) == 0
    shared[tree[1:] != tree[:-1]] = -1
    return shared


def trie_pairs(tree: np.ndarray, label: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Candidate pairs (rows of two keys, the smaller first, no repeats) of texts with these labels.

    The prefix of a label is shortened from DEEPEST levels on while its subtree has at most
    SMALL_SUBTREE members, to ``depth`` levels at the least, and all members of the subtree it ends
    at are paired. Neighbours in trie order that share ``depth`` levels are paired in any case.
    """
    order = np.lexsort((w, label, tree))
    tree, label, w = tree[order], label[order], w[order]
    n = len(w)
    if n < 2:
        return np.zeros((0, 2), np.int64)
    shared = shared_levels(tree, label)
    at = np.flatnonzero(shared >= depth)
    found, above = [np.stack([w[at], w[at + 1]], 1)], np.full(n, n + 1)
    for d in range(depth, DEEPEST + 1):
        first = np.flatnonzero(np.r_[True, shared < d])
        size = np.diff(np.r_[first, n])
        group, held = np.repeat(np.arange(len(first)), size), np.repeat(size, size)
        # small here but not one level up: the prefix is shortened to this level and no further
        ends = (held > 2) & (held <= SMALL_SUBTREE) & (above > SMALL_SUBTREE)
        for gap in range(2, SMALL_SUBTREE):
            at = np.flatnonzero(ends[:-gap] & (group[:-gap] == group[gap:]))
            found.append(np.stack([w[at], w[at + gap]], 1))
        above = held
    both = np.concatenate(found)
    both = np.sort(both[both[:, 0] != both[:, 1]], axis=1)
    return np.unique(both, axis=0)


def _thin(tree: np.ndarray, label: np.ndarray, w: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Which labels of a block to send on, and the pairs of subtrees that do not send all of theirs."""
    order = np.lexsort((label, tree))
    first = np.flatnonzero(np.r_[True, shared_levels(tree[order], label[order]) < depth])
    size = np.diff(np.r_[first, len(order)])
    rank, held = np.arange(len(order)) - np.repeat(first, size), np.repeat(size, size)
    step = lambda r: r * BLOCK_MEMBERS // held
    kept = (held <= BLOCK_MEMBERS) | (rank == 0) | (step(rank) != step(rank - 1))
    large = order[held > BLOCK_MEMBERS]
    return order[kept], trie_pairs(tree[large], label[large], w[large], depth)


def forest_candidates(
    tokens: DataFrame, threshold: float, k: int, trees: int = 48, recall: float = 0.998
) -> DataFrame:
    """``a, b`` (keys ``w``, a < b): pairs that share a subtree in some tree, by ``trie_pairs``.

    The shortest prefix is that of ``depth_for``: a pair at the threshold shares one of that length
    in some tree with probability ``recall``.
    """
    depth = depth_for(threshold, trees, recall)
    total = tokens.count()
    parts = max(8, -(-total * trees // PART_LABELS))

    def label_block(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        table = pa.Table.from_batches(held)
        w, at = np.unique(table.column("w").to_numpy(), return_index=True)
        blobs = table.column("tokens").take(pa.array(at)).to_pylist()
        got, texts = labels(*flat(blobs), trees, k)
        if not len(texts):
            return None
        label, owner, tree = got.ravel(), np.repeat(texts, trees), np.tile(np.arange(trees, dtype=np.uint16), len(texts))
        sent, met = _thin(tree, label, w[owner], depth)
        label, owner, tree = label[sent], owner[sent], tree[sent]
        prefix = mix((label >> np.uint64(64 - 8 * depth)) * np.uint64(trees) + tree)
        part = (prefix % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        label, owner, tree, part = label[order], owner[order], tree[order], part[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows = []
        for a, b in zip(cuts, np.r_[cuts[1:], len(part)]):
            texts_here, index = np.unique(owner[a:b], return_inverse=True)
            rows.append((int(part[a]), tree[a:b].tobytes(), label[a:b].tobytes(), index.astype(np.uint16).tobytes(), w[texts_here].tobytes(), b""))
        if len(met):
            rows.append((int(part[0]), b"", b"", b"", b"", met.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "tree", "label", "text", "w", "met"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_TEXTS):
                held.append(batch.slice(start, BLOCK_TEXTS))
                n += held[-1].num_rows
                if n >= BLOCK_TEXTS:
                    if (out := label_block(held)) is not None:
                        yield out
                    held, n = [], 0
        if held and n and (out := label_block(held)) is not None:
            yield out

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        w = np.concatenate([np.frombuffer(x, np.int64)[np.frombuffer(i, np.uint16)] for x, i in zip(pdf["w"], pdf["text"])])
        both = np.concatenate([trie_pairs(join("tree", np.uint16), join("label", np.uint64), w, depth), join("met", np.int64).reshape(-1, 2)])
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    routed = tokens.select("w", "tokens").mapInArrow(make, "part long, tree binary, label binary, text binary, w binary, met binary")
    return routed.repartition(parts, "part").groupBy("part").applyInPandas(pair, "a long, b long").distinct()


def similarity(a: list[bytes], b: list[bytes], k: int) -> np.ndarray:
    """Share of the different runs of ``k`` words of two texts that both have, for each pair."""
    n = len(a)
    tokens, bounds = flat([*a, *b])
    h, owner = runs(tokens, bounds, k)
    pair, side = owner % n, owner // n
    order = np.lexsort((side, h, pair))
    h, pair, side = h[order], pair[order], side[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (pair[1:] != pair[:-1])] if len(h) else np.zeros(0, bool)
    new_side = fresh | (np.r_[True, side[1:] != side[:-1]] if len(h) else fresh)
    union = np.bincount(pair[fresh], minlength=n)
    sides = np.bincount(pair[new_side], minlength=n)
    return (sides - union) / np.maximum(union, 1)


def verified(candidates: DataFrame, tokens: DataFrame, threshold: float, k: int) -> DataFrame:
    """The candidate pairs ``a, b`` whose similarity is at least ``threshold``."""
    one = tokens.groupBy("w").agg(F.first("tokens").alias("tokens"))
    left = one.select(F.col("w").alias("a"), F.col("tokens").alias("ta"))
    right = one.select(F.col("w").alias("b"), F.col("tokens").alias("tb"))
    both = candidates.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                sim = similarity(part.column(2).to_pylist(), part.column(3).to_pylist(), k)
                keep = pa.array(sim >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep)], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def near_duplicate_links(tokens: DataFrame, threshold: float = 0.8, k: int = 5, trees: int = 48, recall: float = 0.998) -> DataFrame:
    """Links ``a, b`` between different texts (keys ``w``), exact copies standing for one text;
    enough of them to join all of a group (see ``joining_links``).

    Texts without a run of ``k`` words have no similarity to others. No subtree of more than
    SMALL_SUBTREE texts is compared pairwise; what that and the trees leave out is found by
    ``missed_pairs``, so neither that size nor BLOCK_MEMBERS changes which texts come together.
    """
    return all_links(forest_candidates(tokens, threshold, k, trees, recall), tokens, threshold, k)


def joining_links(candidates: DataFrame, tokens: DataFrame, threshold: float, k: int) -> DataFrame:
    """Verified candidates that make up the same groups as all verified candidates do.

    A part of the candidates, chosen by hash, is verified first; of the others those are left whose
    texts are not yet in one group, since a link within a group changes nothing. In a large group
    of alike texts that is almost none, so its texts are not sent once for each of its many pairs.
    """
    found = materialize(candidates, "candidates")
    first = F.pmod(F.xxhash64("a", "b"), F.lit(FIRST_PART)) == 0
    early = materialize(verified(found.where(first), tokens, threshold, k), "links")
    groups = materialize(connected_components(early), "early")
    side = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_group"))
    apart = found.where(~first).join(side("a"), "a", "left").join(side("b"), "b", "left").where(
        ~F.coalesce(F.col("a_group") == F.col("b_group"), F.lit(False))
    )
    late = materialize(verified(apart.select("a", "b"), tokens, threshold, k), "links")
    return early.unionByName(late)


def missed_pairs(tokens: DataFrame, groups: DataFrame, threshold: float, k: int) -> DataFrame:
    """``a, b``: every pair of texts of different groups that may reach ``threshold``; none is lost.

    ``groups`` (``node, component``) holds the groups known so far. The runs of each text are put in
    one order for all, those of rare buckets first. Of two texts with overlap o, the shorter x and the
    longer y, the first common run leaves at least o runs from there on in both, and o is at least
    t / (1 + t) * (|x| + |y|). So the run is among the first of x that leave 2t / (1 + t) * |x| (the
    lead) and among the first of y that leave t * |y|; only these are sent, and met by run. Pairs that
    fail the bound are left out, which ends boilerplate shared below the threshold.
    """
    table = materialize(_bucket_counts(tokens, k), "counts")
    folder = table._weftline_folder
    symbols = tokens.agg(F.sum(F.length("tokens") / 4)).first()[0] or 0
    parts = max(8, -(-int(symbols * (1 - threshold)) // PART_POSTINGS))
    share, lead_share = threshold / (1 + threshold), 2 * threshold / (1 + threshold)
    one = tokens.groupBy("w").agg(F.first("tokens").alias("tokens")).join(groups, F.col("w") == F.col("node"), "left")
    one = one.select("w", F.coalesce("component", "w").alias("grp"), "tokens")

    def postings(batch: pa.RecordBatch, count: np.ndarray) -> pa.RecordBatch | None:
        w, grp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        run, owner = distinct_runs(*flat(batch.column(2).to_pylist()), k)
        df = count[run >> np.uint64(64 - COUNT_BITS)]
        order = np.lexsort((run, df, owner))
        run, owner, df = run[order], owner[order], df[order]
        size = np.bincount(owner, minlength=len(w))
        left = np.cumsum(size)[owner] - np.arange(len(run))  # runs from this one on
        # a run of one text meets no other
        sent = np.flatnonzero((left >= threshold * size[owner] - SLACK) & (df > 1))
        if not len(sent):
            return None
        run, owner, left, df = run[sent], owner[sent], left[sent], df[sent]
        lead = left >= lead_share * size[owner] - SLACK
        # runs of very many texts are salted: every text has one place, the lead comes to all places
        salts = np.minimum(-(-df.astype(np.int64) // HOT_RUN), parts)
        role = np.where(lead & (salts == 1), 3, 1)
        salt = np.where(salts > 1, (w[owner].view(np.uint64) % salts.astype(np.uint64)).astype(np.int64), 0)
        spread = np.flatnonzero(lead & (salts > 1))
        again = np.repeat(spread, salts[spread])
        place = np.arange(len(again)) - np.repeat(np.cumsum(salts[spread]) - salts[spread], salts[spread])
        at = np.r_[np.arange(len(run)), again]
        role, salt = np.r_[role, np.full(len(again), 2)].astype(np.uint8), np.r_[salt, place]
        part = ((run[at] % np.uint64(parts)).astype(np.int64) + salt) % parts
        order = np.argsort(part, kind="stable")
        at, role, part = at[order], role[order], part[order]
        cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        rows = []
        for a, b in zip(cuts, np.r_[cuts[1:], len(part)]):
            here, index = np.unique(owner[at[a:b]], return_inverse=True)
            rows.append((
                int(part[a]), run[at[a:b]].tobytes(), index.astype(np.uint16).tobytes(), left[at[a:b]].astype(np.int32).tobytes(),
                role[a:b].tobytes(), w[here].tobytes(), grp[here].tobytes(), size[here].astype(np.int32).tobytes(),
            ))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "run", "text", "left", "role", "w", "grp", "size"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            if count is None:
                count = _read_counts(folder)
            for start in range(0, batch.num_rows, BLOCK_TEXTS):
                if (out := postings(batch.slice(start, BLOCK_TEXTS), count)) is not None:
                    yield out

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        join = lambda c, kind: np.frombuffer(b"".join(pdf[c]), kind)
        text = np.concatenate([np.frombuffer(i, np.uint16).astype(np.int64) + at for i, at in zip(pdf["text"], np.cumsum([0, *(len(x) // 8 for x in pdf["w"])]))])
        a, b = posting_pairs(
            join("run", np.uint64), join("w", np.int64)[text], join("grp", np.int64)[text], join("size", np.int32)[text].astype(np.int64),
            join("left", np.int32).astype(np.int64), join("role", np.uint8), share,
        )
        return pd.DataFrame({"a": a, "b": b})

    routed = one.mapInArrow(make, "part long, run binary, text binary, left binary, role binary, w binary, grp binary, size binary")
    return routed.repartition(parts, "part").groupBy("part").applyInPandas(meet, "a long, b long").distinct()


def distinct_runs(tokens: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The different runs of each text, by text."""
    run, owner = runs(tokens, bounds, k)
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    fresh = np.r_[True, (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])][: len(run)]
    return run[fresh], owner[fresh]


def _bucket_counts(tokens: DataFrame, k: int) -> DataFrame:
    """``slice, counts``: the number of rows with a run in each bucket of runs, in COUNT_SLICES
    slices; for every run at least the number of texts that have it."""
    width = (1 << COUNT_BITS) // COUNT_SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros(1 << COUNT_BITS, np.uint32)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_TEXTS):
                run, _ = distinct_runs(*flat(batch.column(0).slice(start, BLOCK_TEXTS).to_pylist()), k)
                got += np.bincount((run >> np.uint64(64 - COUNT_BITS)).astype(np.int64), minlength=1 << COUNT_BITS).astype(np.uint32)
        parts = [got[i * width : (i + 1) * width].tobytes() for i in range(COUNT_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_SLICES)), pa.array(parts)], names=["slice", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.uint32)
        for x in pdf["counts"]:
            total += np.frombuffer(x, np.uint32)
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [total.tobytes()]})

    return tokens.select("tokens").mapInArrow(count, "slice long, counts binary").groupBy("slice").applyInPandas(add, "slice long, counts binary")


def _read_counts(folder: str) -> np.ndarray:
    system, path = fs.FileSystem.from_uri(folder)
    got = ds.dataset(path, filesystem=system, format="parquet").to_table().sort_by("slice")
    return np.frombuffer(b"".join(got.column("counts").to_pylist()), np.uint32)


def posting_pairs(
    run: np.ndarray, w: np.ndarray, grp: np.ndarray, size: np.ndarray, left: np.ndarray, role: np.ndarray, share: float
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts of different groups that meet in a run with enough runs left in both.

    role: bit 2 for the shorter text of a pair, bit 1 for the longer. Texts of the most frequent
    group of a run are never held against each other, so a large group of alike texts costs no more
    than its meetings with others.
    """
    _, rank = np.unique(run, return_inverse=True)
    order = np.lexsort((grp, rank))
    edge = np.flatnonzero(np.r_[True, (rank[order][1:] != rank[order][:-1]) | (grp[order][1:] != grp[order][:-1])])
    held = np.diff(np.r_[edge, len(order)])
    by_size = np.argsort(held, kind="stable")
    top = np.zeros(int(rank.max()) + 1, np.int64)
    top[rank[order][edge][by_size]] = grp[order][edge][by_size]  # the last one written is the largest
    common = grp == top[rank]
    short = np.flatnonzero(role & 2)
    most = np.floor(left[short] / share - size[short] + SLACK).astype(np.int64)
    short, most = short[most >= size[short]], most[most >= size[short]]
    found = [np.zeros((0, 2), np.int64)]
    for long_common in (False, True):
        far = np.flatnonzero((role & 1 > 0) & (common == long_common))
        key = rank[far] << 32 | size[far]
        by_key = np.argsort(key, kind="stable")
        far, key = far[by_key], key[by_key]
        near, bound = (short[~common[short]], most[~common[short]]) if long_common else (short, most)
        lo = np.searchsorted(key, rank[near] << 32 | size[near])
        n = np.searchsorted(key, rank[near] << 32 | bound, side="right") - lo
        near, lo, n = near[n > 0], lo[n > 0], n[n > 0]
        # as many at a time as fit; one text's own meetings are cut too
        total, at = np.r_[0, np.cumsum(n)], 0
        while at < total[-1]:
            flat_at = np.arange(at, min(at + MEETINGS, int(total[-1])))
            i = np.searchsorted(total, flat_at, side="right") - 1
            x, y = near[i], far[lo[i] + flat_at - total[i]]
            ok = (grp[x] != grp[y]) & (np.minimum(left[x], left[y]) >= share * (size[x] + size[y]) - SLACK)
            a, b = w[x[ok]], w[y[ok]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0))
            at += MEETINGS
            if sum(map(len, found)) > 4 * MEETINGS:
                found = [np.unique(np.concatenate(found), axis=0)]
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


def all_links(candidates: DataFrame, tokens: DataFrame, threshold: float, k: int) -> DataFrame:
    """Links that make up the same groups as all pairs at ``threshold`` do: those of the candidates,
    and of the pairs between the groups these leave, every one that is left out being a link
    within a group or no link."""
    with scratch(tokens.sparkSession) as keep:
        links = joining_links(candidates, tokens, threshold, k)
        groups = materialize(connected_components(links), "known")
        missed = materialize(missed_pairs(tokens, groups, threshold, k), "missed")
        every = materialize(links.unionByName(verified(missed, tokens, threshold, k)), "links")
        keep(every)
    return every


def group_members(tokens: DataFrame, links: DataFrame) -> DataFrame:
    """``id, grp`` of every row of ``tokens``: equal for rows joined by links or as copies."""
    with scratch(tokens.sparkSession) as keep:
        copies = star_edges(tokens, "w", "p")
        joined = materialize(connected_components(links.select("a", "b").unionByName(copies)), "groups")
        keep(joined)
    members = tokens.select("id", "w").join(joined, F.col("w") == F.col("node"), "left")
    return members.select("id", F.coalesce("component", "w").alias("grp"))


def near_duplicate_groups(tokens: DataFrame, threshold: float = 0.8, k: int = 5, trees: int = 48, recall: float = 0.998) -> DataFrame:
    """``id, grp``, one row per row of ``tokens``; a row like no other has a group of its own."""
    return group_members(tokens, near_duplicate_links(tokens, threshold, k, trees, recall))


def group_pairs(members: DataFrame) -> DataFrame:
    """``example_id_a, example_id_b``: all pairs of rows in one group, the smaller id first."""
    several = materialize(members, "members")
    a = several.select(F.col("id").alias("example_id_a"), "grp")
    b = several.select(F.col("id").alias("example_id_b"), "grp")
    return a.join(b, "grp").where("example_id_a < example_id_b").select("example_id_a", "example_id_b")
