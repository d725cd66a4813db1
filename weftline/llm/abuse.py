"""Abusive, hateful or sexual content (problem 9).

A text is scored passage by passage, and its score is the highest. A passage is a bag of subwords
(words, pairs of words, character n-grams) whose embeddings are averaged and fed into a linear
softmax; embeddings and softmax are trained jointly in numpy, so unseen misspellings share the
vectors of their n-grams. Labels are given for whole texts: of an abusive text only the passage
that the model finds most abusive counts as an example, of a clean one every passage.

Since the average and the softmax are both linear, a trained model is one weight per subword
bucket; scoring gathers and sums.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The model is fitted on at most so many labelled texts, chosen by hash of the id. Everything
#: else covers all texts.
MAX_LABELLED = 20_000
BUCKETS, DIM = 1 << 17, 12
PASSAGE_WORDS = 60
#: Words whose forms and features a worker keeps before it forgets them; memory only, never the result.
KNOWN_WORDS = 400_000
#: Added to the number of subwords when averaging, so that a passage of a word or two says little.
SHRINK = 4

# Letters of other scripts and signs that stand in for Latin letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s",
    "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ո": "n",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t",
    "ı": "i", "@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t",
}
_LOOK = str.maketrans(LOOKALIKES)
# letters in their Latin look, and nothing for invisible characters and accents
_LETTERS_ONLY = str.maketrans(
    {k: v for k, v in LOOKALIKES.items() if k.isalpha()} | {chr(c): None for c in range(0x110000) if unicodedata.category(chr(c)) in ("Cf", "Mn")}
)
# a name of code: capitals within (but for one after a single small letter), a file, an underscore before
# capitals or digits
_IDENTIFIER = re.compile(r"\b_*(?:[A-Z][a-z]*|[a-z]{2,})(?:[A-Z][a-z]{3,}\w*)+(?:\.sol)?\b|\b[a-z](?:[A-Z][a-z]{3,}\w*){2,}\b|\b\w+\.sol\b|\b_+\w*[A-Z0-9]\w*")
_EMPHASIS = re.compile(r"(?<![^\W_])_+|_+(?![^\W_])")
_SPELLED = re.compile(r"(?<![^\W_])[^\W\d_](?:[.\-_*·|]{1,2}[^\W\d_]){2,}(?![^\W_])|(?<![^\W_])[^\W\d_](?: [^\W\d_]){3,}(?![^\W_])")
_DRAWN_OUT = re.compile(r"([^\W\d_])\1{2,}")
# what every spelled word begins with; sought first, since few texts have it
_MAY_SPELL = re.compile(r"(?<![^\W_])[^\W\d_][.\-_*·| ]{1,2}[^\W\d_][.\-_*·| ]")
_SIGNS = re.compile(r"[.\-_*·| ]")
_END = re.compile(r"""(?<=[.!?…。！？])["'”’)]*\s+|[\r\n|]+|(?:\\[nrt])+|"\s*[:,}\]]\s*"?|\u2028|\u2029""")
_PIECE = re.compile(r"\w+(?:[@$#*!+]\w+|[@$#*])*(?:\.sol\b)?|[@$#*]\w+")
_WORD = re.compile(r"[^\W_]+(?:[@$#*!+][^\W_]+|[@$#*])*|[@$#*][^\W_]+")


def plain(text: str) -> str:
    """Without invisible characters, compatibility forms and accents; words spelled letter by letter are joined."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_LETTERS_ONLY)
    return _SPELLED.sub(lambda m: _SIGNS.sub("", m.group()), text) if _MAY_SPELL.search(text) else text


class _Words(dict):
    """The words that each piece of text without blanks stands for: identifiers of code give one word,
    underscores around words, drawn-out letters and signs for letters are undone, numbers are none."""

    def __missing__(self, piece: str) -> tuple[str, ...]:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        text = _EMPHASIS.sub(" ", _IDENTIFIER.sub(" xid ", piece)).lower()
        found = (_DRAWN_OUT.sub(r"\1", w) for w in _WORD.findall(text) if not w.isdigit())
        self[piece] = words = tuple(w if w.isalpha() else w.translate(_LOOK) for w in found)
        return words


_words = _Words()


def passages(text: str | None) -> list[list[str]]:
    """The words of each sentence, line, table cell or quoted field of a text; long ones in parts."""
    if not text or not text.strip():
        return []
    out = []
    for part in _END.split(plain(text)):
        if part and not part.isspace():
            words = [w for piece in _PIECE.findall(part) for w in _words[piece]]
            if len(words) <= PASSAGE_WORDS:
                out.append(words)
                continue
            step = -(-len(words) // -(-len(words) // PASSAGE_WORDS))
            out += [words[i : i + step] for i in range(0, len(words), step)]
    return [p for p in out if p]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of words: buckets, the word each belongs to, and the hash of each word.

    A word gives itself and the n-grams of three to five characters of ``<word>``.
    """
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) for w in marked], np.int64)
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    stop = end[owner] if len(words) else end
    at = np.arange(len(codes))
    feats, owners = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, 6):
        shifted = np.r_[codes[n - 1 :], np.zeros(min(n - 1, len(codes)), np.uint64)]
        h = _mix(h * np.uint64(0x100000001B3) + shifted + np.uint64(n))
        if n >= 3:
            ok = at + n <= stop
            feats.append(h[ok])
            owners.append(owner[ok])
    whole = np.zeros(len(words), np.uint64)
    if len(words):
        place = (at - (end - size)[owner]).astype(np.uint64)
        whole = _mix(np.add.reduceat(_mix(codes * np.uint64(0x9E3779B97F4A7C15) + place), end - size))
    feats.append(whole)
    owners.append(np.arange(len(words)))
    buckets = (np.concatenate(feats) % np.uint64(BUCKETS)).astype(np.int64)
    return buckets, np.concatenate(owners), whole


def word_pairs(whole: np.ndarray) -> np.ndarray:
    """Buckets of words and the next ones, from the hashes of words."""
    two = _mix(whole[:-1] * np.uint64(3) + whole[1:] + np.uint64(77))
    return (two % np.uint64(BUCKETS)).astype(np.int64)


def bags(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all passages together and the passage of each, passages in ascending order."""
    flat = [w for p in parts for w in p]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in flat])
    passage = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    buckets, owner, whole = word_features(list(index))
    order = np.argsort(owner, kind="stable")
    buckets, owner = buckets[order], owner[order]
    size = np.bincount(owner, minlength=len(index))
    first = np.cumsum(size) - size
    reps = size[ids]
    spot = np.repeat(first[ids] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
    feat, own = buckets[spot], np.repeat(passage, reps)
    pair = passage[1:] == passage[:-1]
    feat = np.r_[feat, word_pairs(whole[ids])[pair]]
    own = np.r_[own, passage[1:][pair]]
    order = np.argsort(own, kind="stable")
    return feat[order], own[order]


class Subwords:
    """Embeddings and softmax, trained by Adagrad on mini-batches of passages."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.emb = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
        self.out = (rng.standard_normal((DIM, 2)) * 0.1).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.g_emb = np.full(BUCKETS, 1e-4, np.float32)
        self.g_out = np.full((DIM, 2), 1e-4, np.float32)

    def fit(self, feat, start, size, label, weight, epochs: int, rate: float = 0.25, batch: int = 512) -> None:
        n = len(size)
        for _ in range(epochs):
            for chunk in np.array_split(self.rng.permutation(n), max(1, n // batch)):
                sz = size[chunk]
                spot = np.repeat(start[chunk] - (np.cumsum(sz) - sz), sz) + np.arange(sz.sum())
                f, row = feat[spot], np.repeat(np.arange(len(chunk)), sz)
                edge = np.cumsum(sz) - sz
                avg = np.add.reduceat(self.emb[f], edge, axis=0) / (sz + SHRINK)[:, None]
                z = avg @ self.out + self.bias
                z -= z.max(1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(1, keepdims=True)
                d = p
                d[np.arange(len(chunk)), label[chunk]] -= 1
                d *= weight[chunk][:, None]
                g_out = avg.T @ d
                g_avg = (d @ self.out.T) / (sz + SHRINK)[:, None]
                self.g_out += g_out**2
                self.out -= rate * 0.3 * g_out / np.sqrt(self.g_out)
                self.bias -= 0.01 * d.sum(0)
                used, inv = np.unique(f, return_inverse=True)
                grad = np.empty((len(used), DIM), np.float32)
                for k in range(DIM):
                    grad[:, k] = np.bincount(inv, g_avg[row, k], len(used))
                self.g_emb[used] += (grad**2).mean(1)
                self.emb[used] -= rate * grad / np.sqrt(self.g_emb[used])[:, None]

    def weights(self) -> np.ndarray:
        """Log-odds of each bucket, the bias last; the model's whole effect."""
        return np.r_[self.emb @ (self.out[:, 1] - self.out[:, 0]), self.bias[1] - self.bias[0]].astype(np.float32)


class Scorer:
    """Scores passages by the weights; keeps the summed weights of the subwords of each word it has met."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.total, self.size, self.hash = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def scores(self, parts: list[list[str]]) -> np.ndarray:
        """One score a passage: the softmax of the averaged subwords, 0 without words."""
        if len(self.index) >= KNOWN_WORDS:
            self.forget()
        index, known = self.index, len(self.index)
        ids = np.array([index.setdefault(w, len(index)) for p in parts for w in p], np.int64)
        if len(index) > known:
            buckets, owner, whole = word_features(list(index)[known:])
            self.total = np.r_[self.total, np.bincount(owner, self.weights[:-1][buckets], len(index) - known)]
            self.size = np.r_[self.size, np.bincount(owner, minlength=len(index) - known)]
            self.hash = np.r_[self.hash, whole]
        passage = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        total = np.bincount(passage, self.total[ids], len(parts))
        size = np.bincount(passage, self.size[ids], len(parts))
        pair = passage[1:] == passage[:-1]
        total += np.bincount(passage[1:][pair], self.weights[word_pairs(self.hash[ids])[pair]], len(parts))
        size += np.bincount(passage[1:][pair], minlength=len(parts))
        return np.where(size > 0, 1 / (1 + np.exp(-total / (size + SHRINK) - self.weights[-1])), 0.0)


def train(texts: list[str | None], labels: np.ndarray, rounds: int = 3, seed: int = 7) -> np.ndarray:
    """Weights from texts and the mean of their judges' labels."""
    parts, doc = [], []
    for i, text in enumerate(texts):
        own = passages(text)
        parts += own
        doc += [i] * len(own)
    if not parts or not (labels >= 0.5).any() or (labels >= 0.5).all():
        return np.r_[np.zeros(BUCKETS, np.float32), np.float32(-10 if not (labels >= 0.5).any() else 10)]
    doc = np.array(doc)
    feat, own = bags(parts)
    size = np.bincount(own, minlength=len(parts))
    start = np.cumsum(size) - size
    bad = labels[doc] >= 0.5
    sure = 0.5 + np.abs(labels - 0.5)
    per_doc = np.bincount(doc, minlength=len(texts))
    label = bad.astype(np.int64)
    weight = np.where(bad, 1.0 / per_doc[doc], 1.0) * sure[doc]
    use = np.ones(len(parts), bool)
    for turn in range(rounds):
        model = Subwords(seed + turn)
        w = weight.astype(np.float32)
        at = np.flatnonzero(use)
        epochs = int(np.clip(250_000 / len(at), 5, 25))
        model.fit(feat, start[at], size[at], label[at], w[at], epochs)
        z = np.bincount(own, model.weights()[:-1][feat], len(parts)) / (size + SHRINK) + model.weights()[-1]
        # the worst passage of an abusive text stands for it; a text without any bad one is a slip
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, z)
        top = bad & (z >= best[doc] - 1e-9) & (best[doc] > (-3.0 if turn == 0 else 0.0))
        use = top | ~bad
        # likewise a clean text with a passage scored as plainly abusive counts little
        weight = np.where(bad, 1.0, np.where(z > 1.5, 0.2, 1.0)) * sure[doc]
        label = top.astype(np.int64)
    return model.weights()


def fit_scorer(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> np.ndarray:
    """Trains in one task on at most ``limit`` labelled texts; only the weights (half a megabyte)
    come to the driver. Several judgements of a text are averaged; labels without a text and null
    labels are left out. Without any label nothing is found abusive."""
    judged = (
        labels.where("abusive is not null and doc_id is not null").groupBy("doc_id")
        .agg(F.avg("abusive").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    texts = docs.join(F.broadcast(judged), "doc_id").select("doc_id", "text", "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *batches])
        held = held.sort_values("doc_id", kind="stable")
        out = train(held["text"].tolist(), held["label"].to_numpy(float))
        yield pd.DataFrame({"weights": [out.astype(np.float32).tobytes()]})

    row = texts.repartition(1).mapInPandas(run, "weights binary").first()
    return np.frombuffer(row["weights"], np.float32) if row else train([], np.zeros(0))


def score_texts(docs: DataFrame, weights: np.ndarray, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """``<id_col>, <keep>, score`` of every row: the highest score of any passage, 0 without words."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    df = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            score = np.zeros(len(texts))
            step = 1000
            for a in range(0, len(texts), step):
                parts, doc = [], []
                for i in range(a, min(a + step, len(texts))):
                    own = passages(texts[i])
                    parts += own
                    doc += [i] * len(own)
                if parts:
                    np.maximum.at(score, np.array(doc), scorer.scores(parts))
            cols = [*batch.columns[:-1], pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "score"])

    return df.mapInArrow(run, f"{fields}, score double")
