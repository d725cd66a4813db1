"""Byte-level BPE with vectorised pre-tokenisation (problem 7).

A block of texts is one array of code points. Each code point class acts on the state of the reader as
a transition function. All functions that arise by composing those of the classes are few; they are
numbered, with a table of products, and since composing is associative the states at all places come
out of a blocked prefix scan over products, without any regular expression. States and classes tell
where slices begin; each distinct slice is merged once and cached. Offsets of tokens are kept where
they are asked for, and serve to decode any range of a text.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie on every machine; a parameter of all functions below.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Distinct slices kept by a worker before it forgets them; memory only, never the result.
CACHE_SLICES = 400_000
#: Code points handled at once.
BLOCK_CHARS = 2_000_000

SPACE, BREAK, LETTER, NUMBER, OTHER = 0, 1, 2, 3, 4
# The endings that an apostrophe joins, longest last.
ENDINGS = ["s", "t", "m", "d", "re", "ve", "ll"]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point: blank, other white space, letter, number, anything else."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    for c in range(0x3001):
        ch = chr(c)
        # white space as regular expressions have it: not the four separators U+001C to U+001F
        if ch.isspace() and not 0x1C <= c <= 0x1F:
            table[c] = BREAK
    table[0x20] = SPACE
    return table


# States of the reader after a code point: white space that is or is not a plain blank, a run of
# letters, of numbers, of other signs, and an apostrophe that takes two or one more letters, or none.
AFTER_BREAK, AFTER_SPACE, LETTERS, NUMBERS, OTHERS, TWO, ONE, DONE = range(8)
# Further symbols: an apostrophe with a known ending of one or two letters after it.
QUOTE_ONE, QUOTE_TWO = 5, 6
#: Places of a block that are scanned one after another; all blocks are scanned in step.
SCAN_PLACES = 256


def _act(symbol: int, state: int) -> int:
    if symbol in (SPACE, BREAK):
        return AFTER_SPACE if symbol == SPACE else AFTER_BREAK
    if symbol == LETTER:
        return {TWO: ONE, ONE: DONE}.get(state, LETTERS)
    if symbol in (NUMBER, OTHER) or state in (AFTER_SPACE, OTHERS):
        return NUMBERS if symbol == NUMBER else OTHERS
    return ONE if symbol == QUOTE_ONE else TWO


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, product, act``: the number of each symbol's function (rows: within a text, at its begin,
    where any state before is forgotten), the number of the composition of two (first, then second),
    and the state to which a function leads from each state."""
    plain = [tuple(_act(x, s) for s in range(8)) for x in range(7)]
    known = {f: i for i, f in enumerate(dict.fromkeys([*plain, *((f[AFTER_BREAK],) * 8 for f in plain)]))}
    fresh = list(known)
    while fresh:
        met = {tuple(g[x] for x in f) for f in known for g in fresh} | {tuple(g[x] for x in f) for f in fresh for g in known}
        fresh = [f for f in sorted(met) if f not in known]
        known |= {f: len(known) + i for i, f in enumerate(fresh)}
    product = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], np.uint8)
    start = np.array([[known[f] for f in plain], [known[(f[AFTER_BREAK],) * 8] for f in plain]], np.uint8)
    return start, product, np.array(list(known), np.uint8)


def prefix_products(x: np.ndarray, product: np.ndarray) -> np.ndarray:
    """The product of all elements up to each place, by scanning blocks in step and then their totals."""
    n = len(x)
    if n <= SCAN_PLACES:
        out = x.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], x[i]]
        return out
    blocks = n // SCAN_PLACES
    rows = np.ascontiguousarray(x[: blocks * SCAN_PLACES].reshape(blocks, SCAN_PLACES).T)
    for i in range(1, SCAN_PLACES):
        rows[i] = product[rows[i - 1], rows[i]]
    total = prefix_products(rows[-1], product)
    rows[:, 1:] = product[total[:-1], rows[:, 1:]]
    out = np.concatenate([rows.T.ravel(), x[blocks * SCAN_PLACES :]])
    for i in range(blocks * SCAN_PLACES, n):
        out[i] = product[out[i - 1], out[i]]
    return out


def boundaries(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where slices begin. ``starts``: where texts begin (ascending, the first 0; none empty)."""
    n = len(codes)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[starts] = first[n] = True
    symbol = kind.copy()
    quote = np.flatnonzero(codes == 0x27)
    if len(quote):
        limit = np.r_[starts[1:], n][np.searchsorted(starts, quote, side="right") - 1]
        padded = np.r_[codes, np.zeros(2, codes.dtype)]
        for ending in ENDINGS:
            hit = quote + len(ending) < limit
            for j, ch in enumerate(ending):
                hit &= padded[quote + 1 + j] == ord(ch)
            symbol[quote[hit]] = QUOTE_ONE if len(ending) == 1 else QUOTE_TWO
    start, product, act = transitions()
    state = act[prefix_products(start[first[:n].view(np.uint8), symbol], product), AFTER_BREAK]
    before = np.r_[np.uint8(AFTER_BREAK), state[:-1]]
    before[first[:n]] = AFTER_BREAK
    white = kind <= BREAK
    # a plain blank joins what follows it; a letter after an ending that is done begins anew
    joins = (before == AFTER_SPACE) | (before == state) & (state != DONE) | (before >= TWO) & (before <= ONE)
    cut = ~white & ~joins | white & (before > AFTER_SPACE)
    # the last white space before other text is split off
    cut[:-1] |= white[:-1] & ~white[1:] & ~first[1:n]
    return np.flatnonzero(cut | first[:n])


@lru_cache(2)
def ranks(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    lines = Path(folder, f"{vocabulary}.tiktoken").read_bytes().split(b"\n")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the pair of least rank is joined until none is left, in n log n steps."""
    if (whole := rank.get(piece)) is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        if (r := rank.get(piece[i : i + 2])) is not None:
            heap.append((r, i, piece[i : i + 2]))
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        a, j = parts[i], right[i]
        if a is None or j >= n or parts[j] is None or len(a) + len(parts[j]) != len(joined) or a + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
            if (r := rank.get(pair := joined + parts[right[j]])) is not None:
                heapq.heappush(heap, (r, i, pair))
        if left[i] >= 0 and (r := rank.get(pair := parts[left[i]] + joined)) is not None:
            heapq.heappush(heap, (r, left[i], pair))
    return [rank[p] for p in parts if p is not None]


class Encoder:
    """Encodes lists of texts; keeps the ids of the slices it has met."""

    def __init__(self, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
        self.rank = ranks(folder, vocabulary)
        self.cache: dict[str, list[int]] = {}

    def slices(self, texts: list[str]) -> Iterator[list[str]]:
        """The slices of each text, which must not be empty."""
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        at = boundaries(codes, np.r_[0, ends[:-1]])
        stops = np.r_[at[1:], len(codes)].tolist()
        cut = [whole[a:b] for a, b in zip(at.tolist(), stops)]
        k = 0
        for stop in np.searchsorted(at, ends).tolist():
            yield cut[k:stop]
            k = stop

    def encode(self, texts: list[str]) -> list[list[int]]:
        cache, rank, out = self.cache, self.rank, []
        for parts in self.slices(texts):
            ids: list[int] = []
            for part in parts:
                got = cache.get(part)
                if got is None:
                    if len(cache) >= CACHE_SLICES:
                        cache.clear()
                    got = merge(part.encode("utf-8", "surrogatepass"), rank)
                    if len(part) <= 64:
                        cache[sys.intern(part)] = got
                ids += got
            out.append(ids)
        return out


def encode_blocks(texts: list[str | None], encoder: Encoder) -> Iterator[tuple[int, list[int]]]:
    """``position, ids`` of every text that is neither null nor empty, in order."""
    block, size = [], 0
    for i, text in enumerate(texts):
        if text:
            block.append(i)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from zip(block, encoder.encode([texts[j] for j in block]))
                block, size = [], 0
    if block:
        yield from zip(block, encoder.encode([texts[j] for j in block]))


def encode_corpus(
    df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS,
    vocabulary: str = VOCABULARY, offsets: bool = False,
) -> DataFrame:
    """``<id_col>, ids ARRAY<INT>`` of every row; an empty list for an empty and for a null text.

    Special tokens are not used: their strings are ordinary text. With ``offsets`` a further
    column ``offsets ARRAY<INT>`` tells at which UTF-8 byte each token begins, by which ``decode``
    finds the tokens of any range. Repeated rows come out as often as they are. No shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>" + (", offsets array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(folder, vocabulary)
        length = {i: len(b) for b, i in encoder.rank.items()} if offsets else {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids: list[list[int]] = [[] for _ in texts]
            for i, got in encode_blocks(texts, encoder):
                ids[i] = got
            cols = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
            if offsets:
                starts = [np.cumsum([0] + [length[t] for t in x[:-1]]).tolist() if x else [] for x in ids]
                cols.append(pa.array(starts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "ids"] + ["offsets"] * offsets)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def count_tokens(
    df: DataFrame, id_col: str, text_col: str, masked: str | None = None,
    folder: str = TOKENIZERS, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``<id_col>, n_tokens, n_loss`` of every row; 0 for an empty and for a null text.

    ``n_loss`` counts the tokens that bear a loss: all but the first, which nothing predicts, and but
    those that begin within a match of the expression ``masked`` (on UTF-8 bytes), by their offsets.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(folder, vocabulary)
        hidden = re.compile(masked.encode(), re.S) if masked else None
        length = np.zeros(max(encoder.rank.values()) + 1, np.int64)
        for b, i in encoder.rank.items():
            length[i] = len(b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n, loss = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, got in encode_blocks(texts, encoder):
                n[i] = len(got)
                loss[i] = len(got) - 1
                spans = [m.span() for m in hidden.finditer(texts[i].encode("utf-8", "surrogatepass"))] if hidden else []
                if spans:
                    size = length[got]
                    begin, edges = np.cumsum(size) - size, np.array(spans)
                    at = np.searchsorted(edges[:, 0], begin, side="right") - 1
                    within = (at >= 0) & (begin < edges[np.maximum(at, 0), 1])
                    loss[i] = int((~within[1:]).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(loss)], names=[id_col, "n_tokens", "n_loss"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_loss long")


@lru_cache(2)
def token_bytes(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> dict[int, bytes]:
    return {i: b for b, i in ranks(folder, vocabulary).items()}


def decode(
    ids: list[int], offsets: list[int] | None = None, start: int = 0, stop: int | None = None,
    folder: str = TOKENIZERS, vocabulary: str = VOCABULARY,
) -> bytes:
    """The bytes from ``start`` to ``stop`` of the text with these ids; with ``offsets`` only the tokens
    that meet the range are looked at."""
    back, begin = token_bytes(folder, vocabulary), 0
    if offsets is not None and len(ids):
        a = max(0, int(np.searchsorted(offsets, start, side="right")) - 1)
        b = len(ids) if stop is None else int(np.searchsorted(offsets, stop))
        ids, begin = ids[a:b], int(offsets[a])
    whole = b"".join(back[i] for i in ids)
    return whole[max(0, start - begin) : None if stop is None else max(0, stop - begin)]


def decode_corpus(
    df: DataFrame, id_col: str, ids: str = "ids", offsets: str = "offsets", text: str = "text",
    folder: str = TOKENIZERS, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """``<id_col>, <text>``: the texts of encoded rows. Every token is laid at its offset, so a row whose
    offsets do not fit its ids is an error and not another text. Null ids give a null text, no ids ''."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = token_bytes(folder, vocabulary)
        size = np.zeros(max(back) + 1, np.int64)
        size[list(back)] = [len(b) for b in back.values()]
        for batch in batches:
            out = []
            for own, at in zip(batch.column(1), batch.column(2)):
                if not own.is_valid:
                    out.append(None)
                    continue
                own, at = own.values.to_numpy(zero_copy_only=False), at.values.to_numpy(zero_copy_only=False)
                if len(own) and not np.array_equal(at, np.cumsum(size[own]) - size[own]):
                    raise ValueError("offsets and ids of a row do not fit")
                out.append(b"".join(map(back.__getitem__, own.tolist())).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, text])

    return df.select(id_col, ids, offsets).mapInArrow(run, f"`{id_col}` {kind}, `{text}` string")
