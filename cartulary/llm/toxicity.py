"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of itself and its character n-grams, hashed into buckets; the embeddings of the buckets are averaged
over the words of a window and go through a linear softmax.  Embeddings and softmax are trained jointly: first over
whole documents, then over each document's worst window, found anew in every round.  A document scores as its worst
window does, so a long text cannot drown a few words, and misspellings share n-grams with the words that were seen.

Defined results: null and empty texts, and those without a letter or digit, have no words and score as the bias alone
does; without labels of both kinds in the sample nothing is learned and every score is 0; repeated rows score alike, and
a score depends on its own text alone; words are told apart by 64 bits of a hash of their bare form;
extra columns pass through, ``score`` replaces a column of that name; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cartulary.llm.byte_bpe import _schema, _with
from cartulary.llm.common import give_back, memo, per_slice
from cartulary.llm.labelled import sample

#: Labelled documents that training reads at most.
BOUND = 5000
BUCKETS, DIM, WINDOW, NGRAMS = 1 << 18, 12, 5, (3, 4, 5)
ROUNDS, STEPS, RATE, PUSH, SEED = 16, 25, 0.03, 0.1, 11
#: Words of documents whose windows training looks at together; distinct words whose subwords it does.
TOGETHER, WALK = 200_000, 30_000
_PARTS = re.compile(r"[^\W_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def bare(word: str) -> str:
    """Letters and digits of a word, in lower case."""
    return "".join(_PARTS.findall(word)).lower()


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' subwords, one word after the other, and where each word begins."""
    data = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(words)), sizes)
    left = begin[owner + 1] - np.arange(len(data))
    with np.errstate(over="ignore"):
        whole = np.add.reduceat((data + np.uint64(7)) * (np.arange(len(data)).astype(np.uint64) - begin[owner].astype(np.uint64) + np.uint64(3)) * _P, begin[:-1]) if len(words) else np.zeros(0, np.uint64)
        parts, owners = [whole ^ (whole >> np.uint64(29))], [np.arange(len(words))]
        h, n = data, 1
        for size in NGRAMS:
            while n < size:
                h = (h[:-1] * np.uint64(0x100000001B3)) ^ data[n:]
                n += 1
            ok = np.flatnonzero(left[: len(h)] >= size)
            g = (h[ok] + np.uint64(size)) * _P
            parts.append(g ^ (g >> np.uint64(31)))
            owners.append(owner[ok])
        ids, who = np.concatenate(parts) * _P >> np.uint64(64 - 18), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return ids[order].astype(np.int32), np.searchsorted(who[order], np.arange(len(words)))


def _worst(scores: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document (a stretch of words and their scores) the highest mean of WINDOW words, or of all if it has fewer, and where it begins.

    A word that occurred among the WINDOW - 1 before it in its document counts as neutral, unless it lowers the mean.
    """
    scores = scores.copy()
    ends = np.append(starts[1:], len(scores))
    place = np.arange(len(scores)) - np.repeat(starts, ends - starts)
    for k in range(1, min(WINDOW, len(scores))):
        scores[k:] = np.where((words[k:] == words[:-k]) & (place[k:] >= k), np.minimum(scores[k:], 0), scores[k:])
    best, where = np.zeros(len(starts)), starts.copy()
    mean = np.full(len(scores), -np.inf)
    if len(scores) >= WINDOW:
        # window by window, not from running sums: these would carry digits of the documents before
        mean[: len(scores) - WINDOW + 1] = sum(scores[k : len(scores) - WINDOW + 1 + k] for k in range(WINDOW)) / WINDOW
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        if e - s >= WINDOW:
            k = s + int(mean[s : e - WINDOW + 1].argmax())
            best[i], where[i] = mean[k], k
        elif e > s:
            best[i] = scores[s:e].mean()
    return best, where


class Model:
    """weights: each bucket's embedding times the softmax's difference of classes; a word's score is the mean over its subwords."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self.name = xxhash.xxh3_64_intdigest(self.weights.tobytes())

    def words(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        ids, starts = subwords(words)
        return np.add.reduceat(self.weights[ids].astype(np.float64), starts) / np.diff(np.append(starts, len(ids)))

    def scores(self, texts: list[str]) -> np.ndarray:
        known, docs, unknown = memo(__name__, self.name), [t.split() for t in texts], {}
        for d in docs:
            unknown.update((w, None) for w in d if w not in known)
        # a word is its score and the hash of its bare form; None: it has no letter or digit
        plain = {w: b for w in unknown if (b := bare(w))}
        for w, b, x in zip(plain, plain.values(), self.words(list(plain.values())).tolist(), strict=True):
            unknown[w] = x, xxhash.xxh3_64_intdigest(b)
        known.learn(unknown)
        found = [[x for w in d if (x := unknown[w] if w in unknown else known[w])] for d in docs]
        starts = np.cumsum([0, *map(len, found)])[:-1]
        best, _ = _worst(np.array([x for d in found for x, _ in d], dtype=np.float64), np.array([i for d in found for _, i in d], dtype=np.uint64), starts)
        return 1 / (1 + np.exp(-np.clip(best + self.bias, -40, 40)))


def fit(texts: Iterable[str], labels: list[int]) -> Model | None:
    """Train on whole texts, each read once; None if the labels are not of both kinds."""
    y = np.array(labels, dtype=np.float64)
    if len(set(labels)) < 2:
        return None
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(b, len(index)) for w in t.split() if (b := bare(w))], dtype=np.int32) for t in texts]
    keep = [i for i, d in enumerate(docs) if len(d)]
    docs, y = [docs[i] for i in keep], y[keep]
    if not docs:
        return None
    names, parts = list(index), []
    for k in range(0, len(names), 10_000):
        parts.append(subwords(names[k : k + 10_000]))
    before = np.cumsum([0, *[len(i) for i, _ in parts]])
    ids, starts = np.concatenate([i for i, _ in parts]), np.concatenate([s + n for (_, s), n in zip(parts, before, strict=False)])
    del names, parts, index, before
    give_back()
    sizes = np.diff(np.append(starts, len(ids)))
    flat, begin = np.concatenate(docs), np.cumsum([0, *map(len, docs)])[:-1]
    rng = np.random.default_rng(SEED)
    embed, soft, bias = np.concatenate([rng.normal(0, 0.1, (BUCKETS // 8, DIM)).astype(np.float32) for _ in range(8)]), rng.normal(0, 0.3, (DIM, 2)), 0.0
    moments = [[np.zeros_like(embed), np.zeros(1)], [np.zeros_like(soft), np.zeros_like(soft)], [0.0, 0.0]]
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    step = 0

    def word_scores() -> np.ndarray:
        value, out = embed @ (soft[:, 1] - soft[:, 0]).astype(np.float32), np.empty(len(sizes))
        for i in range(0, len(sizes), WALK):
            j = min(i + WALK, len(sizes))
            out[i:j] = np.add.reduceat(value[ids[starts[i] : starts[j - 1] + sizes[j - 1]]].astype(np.float64), starts[i:j] - starts[i]) / sizes[i:j]
        return out

    def learn(words: np.ndarray, owner: np.ndarray, many: np.ndarray, target: np.ndarray, w: np.ndarray, steps: int) -> None:
        """Bags of words (owner: their row; many: how often) against targets, all rows at once; moves embeddings, softmax and bias."""
        nonlocal bias, step, embed, soft
        owner = owner.astype(np.int32)
        share = (1 / np.bincount(owner, many, minlength=len(target))).astype(np.float32)[owner] * many.astype(np.float32)
        present = np.zeros(len(sizes), dtype=bool)
        present[words] = True
        used = np.flatnonzero(present)
        local = (np.cumsum(present, dtype=np.int32) - 1)[words]
        del present
        # the used words' subwords lie one word after the other; they are walked through some words at a time
        many_parts = sizes[used]
        first = np.cumsum(many_parts) - many_parts
        walks = [(i, min(i + WALK, len(used))) for i in range(0, len(used), WALK)]
        places = np.empty(int(many_parts.sum()), dtype=np.int32)
        for i, j in walks:
            at = np.arange(first[i], first[i] + many_parts[i:j].sum()) + np.repeat(starts[used[i:j]] - first[i:j], many_parts[i:j])
            places[first[i] : first[i] + len(at)] = ids[at]
        # before anything is learned all buckets stand still but the touched ones, so no copy of these is needed
        fresh, buckets = step == 0, slice(None)
        if not fresh:
            touched = np.zeros(BUCKETS, dtype=bool)
            touched[places] = True
            buckets, places = np.flatnonzero(touched), (np.cumsum(touched, dtype=np.int32) - 1)[places]
        part, a = embed[buckets], moments[0][0][buckets]
        grad, b = np.empty_like(part), moments[0][1]
        for _ in range(steps):
            step += 1
            diff = soft[:, 1] - soft[:, 0]
            value, score = part @ diff.astype(np.float32), np.empty(len(used))
            for i, j in walks:
                some = slice(first[i], first[j - 1] + many_parts[j - 1])
                score[i:j] = np.add.reduceat(value[places[some]].astype(np.float64), first[i:j] - first[i]) / many_parts[i:j]
            logit = np.bincount(owner, score[local] * share, minlength=len(target)) + bias
            err = w * (target - 1 / (1 + np.exp(-np.clip(logit, -40, 40)))) / len(target)
            to_words = np.bincount(local, err[owner] * share, minlength=len(used)) / many_parts
            back = np.zeros(len(part))
            for i, j in walks:
                some = slice(first[i], first[j - 1] + many_parts[j - 1])
                back += np.bincount(places[some], np.repeat(to_words[i:j], many_parts[i:j]), minlength=len(part))
            back = back.astype(np.float32)
            to_soft, to_bias = (back @ part).astype(np.float64)[:, None] * np.array([[-1.0, 1.0]]), err.sum()
            # one scale for all buckets: what many documents share moves faster than what one of them has
            np.multiply(back[:, None], (diff * len(target) ** 0.5).astype(np.float32), out=grad)
            b[0] = max(0.99 * b[0], np.abs(back).max(initial=0) * np.abs(diff).max() * len(target) ** 0.5)
            grad -= a
            grad *= 0.1
            a += grad
            np.multiply(a, np.float32(PUSH / (b[0] + 1e-12)), out=grad)
            part += grad
            c, d = moments[1]
            c += 0.1 * (to_soft - c)
            d += 0.01 * (to_soft**2 - d)
            soft = soft + RATE * c / (np.sqrt(d) + 1e-8)
            moments[2] = [moments[2][0] + 0.1 * (to_bias - moments[2][0]), moments[2][1] + 0.01 * (to_bias**2 - moments[2][1])]
            bias += RATE * moments[2][0] / (moments[2][1] ** 0.5 + 1e-8)
        if not fresh:
            embed[buckets], moments[0][0][buckets] = part, a

    lengths, many = np.array([len(d) for d in docs]), len(docs)
    bags = [np.unique(d, return_counts=True) for d in docs]
    del docs
    distinct = np.repeat(np.arange(many, dtype=np.int32), [len(u) for u, _ in bags])
    bags = [np.concatenate(x).astype(np.int32) for x in zip(*bags, strict=True)]
    learn(bags[0], distinct, bags[1], y, weight, STEPS)
    del bags, distinct
    give_back()
    parts = np.searchsorted(begin, np.arange(0, len(flat), TOGETHER))
    parts = [(int(i), int(j)) for i, j in zip(parts, np.append(parts[1:], many), strict=True) if i < j]
    for _ in range(ROUNDS):
        scored, where = word_scores(), begin.copy()
        for i, j in parts:
            words = flat[begin[i] : begin[j - 1] + lengths[j - 1]]
            where[i:j] = _worst(scored[words], words, begin[i:j] - begin[i])[1] + begin[i]
        some = begin + (rng.random(many) * np.maximum(lengths - WINDOW + 1, 1)).astype(np.int64)
        rows = np.concatenate([where, some[y == 0]])
        doc = np.concatenate([np.arange(many), np.flatnonzero(y == 0)])
        size = np.minimum(lengths[doc], WINDOW)
        owner = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + rows[owner]
        learn(flat[at], owner, np.ones(len(at)), y[doc], weight[doc], STEPS)
    return Model(embed @ (soft[:, 1] - soft[:, 0]).astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND, label: str = "toxic") -> Model | None:
    """Fit on at most ``bound`` labelled documents outside fold 1."""
    texts, y = sample(docs, labels, label, bound)
    texts.reverse()
    # each text is let go of once it is read
    model = fit((texts.pop() for _ in range(len(texts))), y)
    give_back()
    return model


def score(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add ``score``, the probability that a text is toxic."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x or "" for x in batch.column(batch.schema.names.index(text)).to_pylist()]
        got = held.value.scores(texts) if held.value else np.zeros(len(texts))
        return _with(batch, {"score": pa.array(got, pa.float64())})

    return df.mapInArrow(per_slice(run, df.columns.index(text)), _schema(df, [("score", T.DoubleType())]))
