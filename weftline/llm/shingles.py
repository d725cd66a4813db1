"""Word tokens and word runs of texts, vectorised over blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.canonical import canonical_text, words_text
from weftline.session import materialize

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BYTE[0x20] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_tokens(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash of each word of texts of words joined by single blanks, and where texts begin.

    The second array has one entry more than there are texts. Values 0 and 1 are never used.
    """
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if words.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint32), np.zeros(len(words) + 1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    edge = np.r_[True, data[:-1] == 0x20]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(edge & (data != 0x20))
    length = np.diff(np.r_[starts, len(data)])
    place = np.arange(len(data)) - np.repeat(starts, length)
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(length.max()), _STEP | np.uint64(1), np.uint64)])
    h = mix(np.add.reduceat(_BYTE[data] * power[place], starts)) >> np.uint64(32)
    return np.maximum(h, 2).astype(np.uint32), np.searchsorted(starts, offsets)


def runs(tokens: np.ndarray, bounds: np.ndarray, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each run of ``k`` tokens within a text, and the text of each."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = max(0, len(tokens) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x100000001B3) + tokens[j : n + j].astype(np.uint64) + np.uint64(j))
    ok = owner[:n] == owner[k - 1 : n + k - 1]
    return h[ok], owner[:n][ok]


def flat(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token arrays stored as bytes, as one array and its bounds."""
    bounds = np.cumsum([0] + [len(b) // 4 for b in blobs])
    return np.frombuffer(b"".join(blobs), np.uint32), bounds


def tokenized(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """``id, <keep>, w, p, tokens``, written to the shared folder once; null and blank texts are left out.

    ``w`` is a 64-bit hash of the word sequence (equal words, equal ``w``), ``p`` one of the
    letters and digits with named fields sorted (equal for copies), ``tokens`` the 32-bit word
    hashes. The text is read and normalised here only, in the JVM; later steps read this table.
    """
    text = F.col(text_col)
    words = words_text(text)
    ready = df.where(text.isNotNull() & text.rlike(r"[^\s\p{Z}]")).select(
        F.col(id_col).alias("id"), *keep, words.alias("words"), F.xxhash64(canonical_text(text, words)).alias("p"),
    ).select("id", *keep, F.xxhash64("words").alias("w"), "p", "words")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema if f.name != "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, bounds = word_tokens(batch.column(batch.num_columns - 1))
            blobs = pa.Array.from_buffers(
                pa.binary(), batch.num_rows, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(tokens)]
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], blobs], names=[*batch.schema.names[:-1], "tokens"])

    return materialize(ready.mapInArrow(run, f"{fields}, tokens binary"), "tokens")
