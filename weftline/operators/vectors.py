"""Pooling and scoring of vectors (M3, M4, M6, M7)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def attention_pool(df: DataFrame, group: str, vector: str, query: Sequence[float]) -> DataFrame:
    """M3 with an identity projection: softmax-weighted mean of the vectors of a group.

    The weight of a vector is ``exp(query . tanh(x))``; numerator and denominator are sums by
    dimension, so the aggregate combines on the map side and a hot group is no bottleneck. Scores
    are bounded by the query's absolute sum, which is subtracted, so nothing overflows. Null vectors
    are left out.
    """
    bound = float(np.abs(np.asarray(query)).sum())
    q = F.array(*[F.lit(float(x)) for x in query])
    w = F.exp(dot(F.transform(vector, lambda x: F.tanh(x.cast("double"))), q) - bound)
    d = len(query)
    sums = [F.sum(F.col("__w") * F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"__s{i}") for i in range(d)]
    out = df.where(F.col(vector).isNotNull()).withColumn("__w", w).groupBy(group).agg(
        F.count("*").alias("n"), F.sum("__w").alias("__z"), *sums
    )
    return out.select(group, "n", F.array(*[F.col(f"__s{i}") / F.col("__z") for i in range(d)]).alias("pooled"))


def pool_and_score(df: DataFrame, id_col: str, vectors: str, params: dict[str, np.ndarray]) -> DataFrame:
    """M3/M4/M7: probability of every row from its ragged array of vectors.

    ``params``: W, b, v of the attention, W1, b1, W2, b2 of the head (a bounded set of weights).
    Batches are pooled without padding. An empty or null array has a null probability.
    """
    shared = df.sparkSession.sparkContext.broadcast(params)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        for pdf in batches:
            rows = [None if v is None or len(v) == 0 else np.stack(v).astype(float) for v in pdf[vectors]]
            kept = [r for r in rows if r is not None]
            prob = np.full(len(pdf), np.nan)
            if kept:
                x, size = np.concatenate(kept), np.array([len(r) for r in kept])
                first = np.cumsum(size) - size
                s = np.tanh(x @ p["W"].T + p["b"]) @ p["v"]
                e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), size))
                w = e / np.repeat(np.add.reduceat(e, first), size)
                pooled = np.add.reduceat(x * w[:, None], first, axis=0)
                z = np.maximum(pooled @ p["W1"].T + p["b1"], 0) @ p["W2"] + p["b2"]
                prob[[r is not None for r in rows]] = 1 / (1 + np.exp(-z))
            yield pd.DataFrame({id_col: pdf[id_col], "prob": pd.Series(prob).astype(object).where(~np.isnan(prob), None)})

    return df.select(id_col, vectors).mapInPandas(run, f"`{id_col}` {kind}, prob double")


def hashed_encoder(dim: int = 64):
    """A deterministic stand-in for a text encoder: signed hashes of the words, unit length."""
    import hashlib

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            norm = np.linalg.norm(v)
            out.append((v / norm if norm else v).astype(np.float32).tolist())
        return out

    return encode


def counting_encoder():
    """An encoder whose vectors SQL can work out too: letters, words between blanks, digits of a text."""

    def encode(texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(t.count(" ") + 1), float(sum(c in "0123456789" for c in t))] for t in texts]

    return encode


def train_head(x: np.ndarray, y: np.ndarray, hidden: int = 16, epochs: int = 200, patience: int = 20, seed: int = 42, rate: float = 1e-3, decay: float = 1e-5) -> dict[str, np.ndarray]:
    """M6: a two-layer head on pooled vectors: weighted logistic loss, Adam, early stopping.

    ``x`` is the bounded training table of pooled vectors (rows x dimensions), a tenth of which
    decides when to stop; the weights of the best epoch are copied, not aliased.
    """
    rng = np.random.default_rng(seed)
    n, d = x.shape
    order = rng.permutation(n)
    val, tr = order[: max(1, n // 10)], order[max(1, n // 10):]
    w = (y == 0).sum() / max(1, (y == 1).sum()) if (y == 1).any() else 1.5
    p = {"W1": rng.normal(0, d**-0.5, (hidden, d)), "b1": np.zeros(hidden), "W2": rng.normal(0, hidden**-0.5, hidden), "b2": np.zeros(())}
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    best, kept, bad, t = np.inf, {k: a.copy() for k, a in p.items()}, 0, 0

    def forward(i):
        h = np.maximum(x[i] @ p["W1"].T + p["b1"], 0)
        return h, 1 / (1 + np.exp(-(h @ p["W2"] + p["b2"])))

    for _ in range(epochs):
        for i in np.array_split(rng.permutation(tr), max(1, len(tr) // 32)):
            h, q = forward(i)
            g = (q - y[i]) * np.where(y[i] == 1, w, 1.0) / len(i)
            gh = np.outer(g, p["W2"]) * (h > 0)
            grads = {"W1": gh.T @ x[i], "b1": gh.sum(0), "W2": h.T @ g, "b2": g.sum()}
            t += 1
            for k in p:
                gk = grads[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        q = np.clip(forward(val)[1], 1e-9, 1 - 1e-9)
        loss = -(np.where(y[val] == 1, w * np.log(q), np.log(1 - q))).mean()
        if loss < best - 1e-9:
            best, kept, bad = loss, {k: np.array(a, copy=True) for k, a in p.items()}, 0
        elif (bad := bad + 1) >= patience:
            break
    return kept
