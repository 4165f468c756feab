"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word, and every shape of a word, has a sparse random index vector that follows from its hash; a word's vector is
its own index vector plus the sum of those of its neighbours in the training sample, scaled.  A document is the mean of
its words' vectors, the mean of its shapes' vectors, and how varied its words and lines are; two layers of numpy turn
that into a logit, and a temperature fitted on a part of the sample that training does not see calibrates it.

Defined results: null and empty texts pool to zero vectors and get the network's score of those; without labels of both
kinds in the sample every score is the share of label 1, or 0.5 without any; repeated rows score alike; extra columns pass
through, ``score`` replaces a column of that name; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartulary.llm.byte_bpe import _schema, _with
from cartulary.llm.common import memo, per_slice
from cartulary.llm.labelled import sample

#: Labelled documents that training reads at most.
BOUND = 6000
WORDS, SHAPES, DIM, NONZERO, REACH = 1 << 15, 1 << 12, 48, 6, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY, SEED = 32, 60, 64, 0.003, 1e-4, 5
_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[0-9]+")


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """NONZERO entries of +1 or -1 in each row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIM), dtype=np.float32)
    for _ in range(NONZERO):
        out[np.arange(rows), rng.integers(0, DIM, rows)] += rng.choice([-1.0, 1.0], rows).astype(np.float32)
    return out / np.sqrt(NONZERO)


def bucket(word: str) -> int:
    """The word's bucket, and that of its shape above it."""
    shape = _DIGIT.sub("9", _UPPER.sub("X", _LOWER.sub("x", word)))
    return zlib.crc32(word.strip(".,;:!?").lower().encode("utf-8", "replace")) % WORDS + WORDS * (zlib.crc32(shape.encode("utf-8", "replace")) % SHAPES)


class Pool:
    """Turns texts into rows of features; vectors: of the words, as learned from the sample."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.shapes = vectors, index_vectors(SHAPES, SEED + 1)

    def __getstate__(self):
        return {"vectors": self.vectors}

    def __setstate__(self, state):
        self.__init__(state["vectors"])

    def ids(self, words: list[str]) -> np.ndarray:
        known = memo(__name__)
        found = list(map(known.get, words))
        if None in found:
            new = {w: bucket(w) for w, i in zip(words, found, strict=True) if i is None}
            found = [new[w] if i is None else i for w, i in zip(words, found, strict=True)]
            known.learn(new)
        return np.array(found, dtype=np.int64)

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIM + 4), dtype=np.float32)
        for row, text in zip(out, texts, strict=True):
            words = text.split()
            if not words:
                continue
            ids, n = self.ids(words), len(words)
            for part, table, which in ((0, self.vectors, ids % WORDS), (DIM, self.shapes, ids // WORDS)):
                used, counts = np.unique(which, return_counts=True)
                row[part : part + DIM] = (counts.astype(np.float32) / n) @ table[used]
            lines = [x for x in text.split("\n") if x.strip()]
            row[2 * DIM :] = np.log1p(n) / 8, len(set(words)) / n, len(set(words)) / n**0.85, 1 - len(set(lines)) / max(len(lines), 1)
        return out


class Network:
    """Standardised features, one hidden layer, one logit, and the temperature that divides it."""

    def __init__(self, pool: Pool, centre, scale, layers, temperature: float):
        self.pool, self.centre, self.scale, self.layers, self.temperature = pool, centre, scale, layers, temperature

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.centre) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pool.features(texts)) / self.temperature, -40, 40)))


def word_vectors(pool: Pool, texts: list[str]) -> np.ndarray:
    """Index vectors plus those of the REACH neighbours to each side, by random indexing over the texts."""
    index = index_vectors(WORDS, SEED)
    context = np.zeros_like(index)
    for text in texts:
        ids = pool.ids(text.split()) % WORDS if text.strip() else np.zeros(0, dtype=np.int64)
        if len(ids) < 2:
            continue
        near = np.zeros((len(ids), DIM), dtype=np.float32)
        for k in range(1, min(REACH, len(ids) - 1) + 1):
            near[k:] += index[ids[:-k]]
            near[:-k] += index[ids[k:]]
        order = np.argsort(ids, kind="stable")
        used, first = np.unique(ids[order], return_index=True)
        context[used] += np.add.reduceat(near[order], first)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    return index + context / np.maximum(norm, 1)


def fit(texts: list[str], labels: list[int]) -> Network | float:
    """Train on whole texts; a constant if the labels are not of both kinds."""
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return float(y.mean()) if len(y) else 0.5
    pool = Pool(index_vectors(WORDS, SEED))
    pool.vectors = word_vectors(pool, texts).astype(np.float32)
    x = pool.features(texts).astype(np.float64)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    unseen, seen = order[: len(y) // 5], order[len(y) // 5 :]
    centre, scale = x[seen].mean(axis=0), x[seen].std(axis=0) + 1e-3
    layers = [rng.normal(0, (1 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), 0.0]
    net = Network(pool, centre, scale, layers, 1.0)
    moments, step = [[np.zeros_like(w), np.zeros_like(w)] for w in map(np.asarray, layers)], 0
    z = (x - centre) / scale
    for _ in range(EPOCHS):
        rng.shuffle(seen)
        for part in np.array_split(seen, max(1, len(seen) // BATCH)):
            step += 1
            w1, b1, w2, b2 = net.layers
            h = np.tanh(z[part] @ w1 + b1)
            err = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40))) - y[part]) / len(part)
            back = err[:, None] * w2 * (1 - h * h)
            grads = (z[part].T @ back + DECAY * w1, back.sum(axis=0), h.T @ err + DECAY * w2, err.sum())
            for i, (g, (a, b)) in enumerate(zip(grads, moments, strict=True)):
                a[...] = 0.9 * a + 0.1 * g
                b[...] = 0.999 * b + 0.001 * g * g
                net.layers[i] = net.layers[i] - RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    if len(unseen):
        logits = net.logits(x[unseen])
        loss = lambda t: np.mean(np.logaddexp(0, -np.where(y[unseen] == 1, 1, -1) * logits / t))
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND, label: str = "quality") -> Network | float:
    """Fit on at most ``bound`` labelled documents outside fold 1."""
    return fit(*sample(docs, labels, label, bound))


def score(df: DataFrame, net: Network | float, text: str = "text") -> DataFrame:
    """Add ``score``, the calibrated probability of label 1."""
    held = df.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, known = [x or "" for x in batch.column(batch.schema.names.index(text)).to_pylist()], held.value
        return _with(batch, {"score": pa.array(np.full(len(texts), known) if isinstance(known, float) else known.scores(texts), pa.float64())})

    return df.mapInArrow(per_slice(run, df.columns.index(text)), _schema(df, [("score", T.DoubleType())]))
