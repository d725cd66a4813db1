"""Same or near-same records across splits (problem 5): a full-text index of evaluation shards.

The texts of a shard, as sequences of word symbols, are indexed by their Burrows-Wheeler transform:
for each symbol the ranks at which it stands, delta-coded and compressed in the shared folder, and
the text of each rank and the place in it. Training texts are streamed through backward search, all
windows of the least length of a block in step; windows found one after another in a text make up a
maximal match with it. Matches are merged into spans and counts for each pair of texts.
Training texts meet only the shards with which they share a winnowed fingerprint, which every match
long enough to be reported implies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shingles import flat, runs
from weftline.session import materialize, new_path, scratch

#: Symbols of one shard on average: bounds the index that a task holds at a time (about 24 bytes each).
SHARD_SYMBOLS = 3_000_000
#: Texts searched in one task on average.
ROUTED_TEXTS = 8_000
#: Texts of a block that are searched in step, by symbols.
BLOCK_SYMBOLS = 400_000
#: Windows found that are held at a time, those of one text at least.
FOUND_WINDOWS = 2_000_000
END = 0


@dataclass
class Index:
    """``lf``: symbol << 32 | rank, sorted, so that a position in it is the next rank of backward
    search; ``text``: the text (by position in ``keys``) of each rank; ``sizes``: symbols of each text;
    ``place``: the symbol of its text at which each rank's suffix begins."""

    lf: np.ndarray
    text: np.ndarray
    keys: np.ndarray
    sizes: np.ndarray
    place: np.ndarray


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling of ranks."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    gap = 1
    while True:
        second = np.full(n, 0, np.int64)
        second[: n - gap] = rank[gap:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        new = np.cumsum(np.r_[0, sorted_pair[1:] != sorted_pair[:-1]])
        rank[order] = new
        if new[-1] == n - 1 or gap >= n:
            return order
        gap *= 2


def build_index(keys: np.ndarray, tokens: np.ndarray, bounds: np.ndarray) -> Index:
    """Index of texts given as one token array with bounds; each text is closed by an own end."""
    sizes = np.diff(bounds)
    n = len(tokens) + len(keys)
    symbols = np.full(n, END, np.int64)
    spot = np.arange(len(tokens)) + np.repeat(np.arange(len(keys)), sizes)
    symbols[spot] = tokens
    owner = np.repeat(np.arange(len(keys)), sizes + 1)
    # distinct ends keep matches inside a text and suffixes distinct
    unique = symbols + len(keys)
    unique[symbols == END] = np.arange(len(keys))
    order = suffix_order(unique)
    before = symbols[order - 1]
    before[order == 0] = END
    lf = (before.astype(np.uint64) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    lf.sort()
    # ends come first in the suffix order, as the symbol END does in lf
    place = np.arange(n) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    return Index(lf, owner[order].astype(np.int32), keys, sizes, place[order].astype(np.int32))


def write_rows(shard: int, index: Index) -> pd.DataFrame:
    """The index as rows of compressed parts: gaps between sorted values instead of the values."""
    deltas = np.diff(np.r_[np.uint64(0), index.lf])
    parts = {"lf": deltas, "text": index.text, "keys": index.keys, "sizes": index.sizes.astype(np.int64), "place": index.place}
    codec = pa.Codec("zstd")
    return pd.DataFrame(
        [(shard, k, v.dtype.str, v.nbytes, codec.compress(v.tobytes(), asbytes=True)) for k, v in parts.items()],
        columns=["shard", "part", "dtype", "size", "data"],
    )


def read_index(rows: list[dict]) -> Index:
    codec = pa.Codec("zstd")
    part = {r["part"]: np.frombuffer(codec.decompress(r["data"], r["size"], asbytes=True), r["dtype"]) for r in rows}
    return Index(np.cumsum(part["lf"]), part["text"], part["keys"], part["sizes"], part["place"])


def backward_matches(index: Index, tokens: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """``pattern, start, length, low, high``: stretches of at least ``least`` symbols.

    Read from the right, every pattern is cut into the longest stretches that stand in the index;
    ``low`` and ``high`` bound the ranks at which a stretch stands. A pattern that stands whole is
    one stretch, but a stretch hides shorter matches with other texts: see ``maximal_matches``.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")  # patterns still running stay a prefix
    start, size = bounds[:-1][order], sizes[order]
    n = len(order)
    low, high, length = np.zeros(n, np.uint64), np.full(n, len(index.lf), np.uint64), np.zeros(n, np.int64)
    out: list[tuple[np.ndarray, ...]] = []

    def report(which: np.ndarray, at: np.ndarray) -> None:
        good = length[which] >= least
        w = which[good]
        if len(w):
            out.append((order[w], at[good], length[w].copy(), low[w].astype(np.int64), high[w].astype(np.int64)))

    longest = int(size.max()) if n else 0
    for step in range(longest):
        alive = int(np.searchsorted(-size, -step, side="left"))
        run = np.arange(alive)
        at = size[:alive] - 1 - step
        code = tokens[start[:alive] + at].astype(np.uint64) << np.uint64(32)
        lo = np.searchsorted(index.lf, code | low[:alive])
        hi = np.searchsorted(index.lf, code | high[:alive])
        lost = lo >= hi
        if lost.any():
            ended = run[lost]
            report(ended, at[lost] + 1)
            lo1 = np.searchsorted(index.lf, code[lost])
            hi1 = np.searchsorted(index.lf, code[lost] | np.uint64(0xFFFFFFFF), side="right")
            none = lo1 >= hi1
            lo[lost] = np.where(none, 0, lo1)
            hi[lost] = np.where(none, len(index.lf), hi1)
            length[ended] = np.where(none, -1, 0)
        low[:alive], high[:alive] = lo, hi
        length[:alive] += 1
        done = run[size[:alive] == step + 1]
        if len(done):
            report(done, np.zeros(len(done), np.int64))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out))


def merge_matches(index: Index, matches: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """``pattern, text, spans, covered, longest`` for each pattern and text with a match."""
    pattern, _, length, low, high = matches
    count = high - low
    rank = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    which = np.repeat(np.arange(len(pattern)), count)
    text = index.text[rank].astype(np.int64)
    # a stretch that stands several times in a text counts once for it
    once = np.unique(which * (len(index.keys) + 1) + text)
    which, text = once // (len(index.keys) + 1), once % (len(index.keys) + 1)
    key, inv = np.unique(pattern[which] * (len(index.keys) + 1) + text, return_inverse=True)
    spans = np.bincount(inv, minlength=len(key))
    covered = np.bincount(inv, length[which], len(key)).astype(np.int64)
    longest = np.zeros(len(key), np.int64)
    np.maximum.at(longest, inv, length[which])
    return key // (len(index.keys) + 1), key % (len(index.keys) + 1), spans, covered, longest


def maximal_matches(index: Index, tokens: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``pattern, text, start, length`` of every match of at least ``least`` symbols of a pattern with
    a text that can be extended to neither side; the matches of one pattern come together."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), np.maximum(size - least + 1, 0))
    first = np.cumsum(np.maximum(size - least + 1, 0)) - np.maximum(size - least + 1, 0)
    at = bounds[:-1][owner] + np.arange(len(owner)) - first[owner]
    low, high = np.zeros(len(at), np.uint64), np.full(len(at), len(index.lf), np.uint64)
    for step in range(least - 1, -1, -1):
        code = tokens[at + step].astype(np.uint64) << np.uint64(32)
        low, high = np.searchsorted(index.lf, code | low), np.searchsorted(index.lf, code | high)
        stands = low < high
        at, owner, low, high = at[stands], owner[stands], low[stands].astype(np.uint64), high[stands].astype(np.uint64)
    low, count = low.astype(np.int64), (high - low).astype(np.int64)
    total = np.r_[0, np.cumsum(count)]
    begin = np.cumsum(index.sizes + 1) - index.sizes - 1
    edges = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]) if len(owner) else np.zeros(1, np.int64)
    i = 0
    while i < len(edges) - 1:
        j = max(i + 1, int(np.searchsorted(total[edges], total[edges[i]] + FOUND_WINDOWS, side="right")) - 1)
        a, b = edges[i], edges[j]
        i = j
        which = np.repeat(np.arange(a, b), count[a:b])
        rank = low[which] + np.arange(len(which)) + total[a] - total[which]
        text, here = index.text[rank].astype(np.int64), at[which]
        diagonal = here - begin[text] - index.place[rank]
        order = np.lexsort((here, diagonal))
        text, here, diagonal, pattern = text[order], here[order], diagonal[order], owner[which][order]
        new = np.flatnonzero(np.r_[
            True, (diagonal[1:] != diagonal[:-1]) | (here[1:] != here[:-1] + 1) | (pattern[1:] != pattern[:-1])
        ])
        length = np.diff(np.r_[new, len(here)]) + least - 1
        yield pattern[new], text[new], here[new] - bounds[:-1][pattern[new]], length


def merge_spans(texts: int, pattern: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """``pattern, text, spans, covered, longest`` for each pattern and text (of ``texts``) with a match:
    overlapping matches make one span of the pattern, and a symbol counts once."""
    key = pattern * texts + text
    order = np.lexsort((start, key))
    key, start, length = key[order], start[order], length[order]
    pair, inv = np.unique(key, return_inverse=True)
    base = inv * (int((start + length).max()) + 1)
    reached = np.maximum.accumulate(base + start + length)
    before = np.r_[-1, reached[:-1]]
    covered = np.bincount(inv, np.maximum(reached - np.maximum(before, base + start), 0), len(pair)).astype(np.int64)
    spans = np.bincount(inv, base + start >= before, len(pair)).astype(np.int64)
    longest = np.zeros(len(pair), np.int64)
    np.maximum.at(longest, inv, length)
    return pair // texts, pair % texts, spans, covered, longest


def index_shards(texts: DataFrame, symbols: int) -> tuple[str, int]:
    """Indexes ``key, tokens`` (distinct texts, ``symbols`` in all) into the shared folder."""
    spark = texts.sparkSession
    shards = max(1, -(-symbols // SHARD_SYMBOLS))
    path = new_path(spark, "fulltext")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        blobs = pdf["tokens"].tolist()
        bounds = np.cumsum([0] + [len(b) // 4 for b in blobs])
        return write_rows(
            int(pdf["shard"].iloc[0]),
            build_index(pdf["key"].to_numpy(np.int64), np.frombuffer(b"".join(blobs), np.uint32), bounds),
        )

    (
        texts.select("key", "tokens", shard_of(shards).alias("shard"))
        .repartition(shards, "shard").groupBy("shard").applyInPandas(build, "shard long, part string, dtype string, size long, data binary")
        .write.option("compression", "none").partitionBy("shard").parquet(path)
    )
    return path, shards


def fingerprints(tokens: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed fingerprints of texts, and the text of each: any two texts that share a run of
    ``least`` symbols share one. Of each window of run hashes that such a run spans, the least is taken."""
    k = max(1, least - 2)
    w = least - k + 1
    h, owner = runs(tokens, bounds, k)
    if len(h) < w:
        return h[:0], owner[:0]
    windows = np.lib.stride_tricks.sliding_window_view(h, w)
    inside = owner[: len(windows)] == owner[w - 1 :]
    chosen = np.unique((np.arange(len(windows)) + windows.argmin(1))[inside])
    return h[chosen], owner[chosen]


def _fingerprint_table(texts: DataFrame, least: int, value: str) -> DataFrame:
    """``fp, <value>`` of each text's fingerprints; ``value`` is a bigint column of ``texts``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                fp, owner = fingerprints(*flat(part.column(1).to_pylist()), least)
                both = np.unique(np.stack([fp.view(np.int64), part.column(0).to_numpy()[owner]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["fp", value])

    return texts.select(value, "tokens").mapInArrow(run, f"fp long, {value} long")


def route(streamed: DataFrame, indexed: DataFrame, shards: int, least: int) -> DataFrame:
    """``key, shard``: the shards that may hold a match of each streamed text, and no others.

    Texts are routed by shared fingerprints, which loses no match of ``least`` symbols, so a text
    that shares nothing with the index is never searched, and the work follows the overlaps, not
    texts times shards. A fingerprint has at most one row a shard on the indexed side.
    """
    there = _fingerprint_table(indexed.withColumn("shard", shard_of(shards)), least, "shard").distinct()
    there = materialize(there, "indexed")
    return _fingerprint_table(streamed, least, "key").join(there, "fp").select("key", "shard").distinct()


def shard_of(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards))


def stream_matches(routed: DataFrame, path: str, least: int, whole: bool = False) -> DataFrame:
    """``a, b, spans, covered, longest``: each routed text (``key, tokens, shard``) with each text of
    that shard with which it shares a maximal match of at least ``least`` symbols.

    With ``whole`` only matches of complete texts count. Rows must come sorted by shard within
    each partition; a task holds one shard's index at a time, read from the shared folder.
    """

    def load(shard: int) -> Index:
        system, folder = fs.FileSystem.from_uri(f"{path}/shard={shard}")
        return read_index(ds.dataset(folder, filesystem=system, format="parquet").to_table().to_pylist())

    def search(index: Index, keys: np.ndarray, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        size, block = 0, []
        cuts = []
        for i, blob in enumerate(blobs):
            block.append(i)
            size += len(blob) // 4
            if size >= BLOCK_SYMBOLS:
                cuts.append(block)
                size, block = 0, []
        for block in [*cuts, *([block] if block else [])]:
            tokens, bounds = flat([blobs[i] for i in block])
            if whole:
                pattern, text, spans, covered, longest = merge_matches(index, backward_matches(index, tokens, bounds, least))
                full = (longest == np.diff(bounds)[pattern]) & (longest == index.sizes[text])
                merged = [tuple(x[full] for x in (pattern, text, spans, covered, longest))]
            else:
                merged = (merge_spans(len(index.keys), *found) for found in maximal_matches(index, tokens, bounds, least))
            for pattern, text, spans, covered, longest in merged:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (keys[block][pattern], index.keys[text], spans, covered, longest)],
                    names=["a", "b", "spans", "covered", "longest"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            shard = batch.column(2).to_numpy()
            cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
            for a, b in zip(cut, np.r_[cut[1:], len(shard)]):
                if shard[a] != held:
                    held, index = shard[a], None
                    index = load(int(held))
                part = batch.slice(a, b - a)
                yield from search(index, part.column(0).to_numpy(), part.column(1).to_pylist())

    return routed.select("key", "tokens", "shard").mapInArrow(run, "a long, b long, spans long, covered long, longest long")


def cross_matches(sides: DataFrame, least: int, whole: bool = False) -> DataFrame:
    """Matches of the texts of ``sides`` (``key, tokens, is_train``) across the two sides.

    The texts with ``is_train`` false are indexed, those with true streamed, copies (rows of one
    key) once. Null tokens are left out; an empty side gives an empty table.
    """
    sides = sides.where("tokens is not null and key is not null and is_train is not null")
    indexed, streamed = sides.where("not is_train"), sides.where("is_train")
    symbols = indexed.agg(F.sum(F.length("tokens") / 4 + 1)).first()[0]
    if not symbols:
        return sides.sparkSession.createDataFrame([], "a long, b long, spans long, covered long, longest long")
    with scratch(sides.sparkSession) as keep:
        path, shards = index_shards(indexed, int(symbols))
        routes = materialize(route(streamed, indexed, shards, least), "routes")
        groups = max(1, routes.count() // ROUTED_TEXTS)
        salt = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(-(-groups // shards))).alias("salt")
        once = streamed.groupBy("key").agg(F.first("tokens").alias("tokens"))
        routed = routes.join(once, "key").select("key", "tokens", "shard", salt)
        placed = routed.repartition(max(1, min(groups, 100_000)), "shard", "salt").sortWithinPartitions("shard")
        matches = materialize(stream_matches(placed, path, least, whole), "matches")
        keep(matches)
    return matches
