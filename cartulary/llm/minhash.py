"""Near duplicates by ProbMinHash: words in runs of five, weighted by how often they occur.

Each shingle of a document is a Poisson process whose rate is the shingle's count; its arrivals fall into registers, and a
register holds the shingle that arrived first.  A shingle stops as soon as its next arrival is later than every register's.
Two documents agree in a register with the probability Jaccard similarity of their weighted shingles.  Documents that agree
in a whole band are candidates; candidates are verified by the exact similarity, and linked documents form classes.

Texts with the same words are one node from the start.  In a bucket every member is compared with the smallest one; where a
bucket still holds several classes after that, the members outside the smallest one's class are compared, in bounded
blocks, with all members, by a byte of each register first and exactly then, within the task: only links that join classes
come out of it.  So no bucket's pairs are written out, and none are left out.

Defined results: null, empty and white-space texts have no shingles and are classes of their own; fewer than five words
are one shingle; a repeated id stands for one document, so its rows share a class; rows without an id take part in no class
(class null, kept); extra columns pass through, output columns replace input columns of the same name; an empty table gives
an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import HOT, WORD, cut, fresh, join_hot, memo, per_slice
from cartulary.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
#: Registers that must agree before a pair of a mixed bucket is verified: far below what chance leaves to similar pairs.
ESTIMATE, BLOCK = 0.62, 256
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def word_ids(text: str) -> np.ndarray:
    words, known = WORD.findall(text), memo(__name__)
    found = list(map(known.get, words))
    if None in found:
        new = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w, i in zip(words, found, strict=True) if i is None}
        found = [new[w] if i is None else i for w, i in zip(words, found, strict=True)]
        known.learn(new)
    return np.array(found, dtype=np.uint64)


def shingles(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash of each run of ``size`` words; of all words, if there are fewer."""
    n = min(size, len(ids))
    if not n:
        return ids
    out = np.full(len(ids) - n + 1, n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _A + ids[k : len(ids) - n + 1 + k])
    return out


def weighted(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each list (52 bits), how often each occurs, and the list it is from."""
    owner = np.repeat(np.arange(len(hashes), dtype=np.uint64), [len(h) for h in hashes])
    out = []
    for start in range(0, len(hashes), 4096):  # the list's number takes the upper 12 bits
        lo, hi = np.searchsorted(owner, [start, start + 4096])
        keys = np.sort(((owner[lo:hi] - np.uint64(start)) << np.uint64(52)) | (np.concatenate(hashes[start : start + 4096]) >> np.uint64(12)) if hi > lo else np.zeros(0, np.uint64))
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[first], np.diff(np.append(first, len(keys)))
        out.append((keys & np.uint64((1 << 52) - 1), counts, (keys >> np.uint64(52)).astype(np.int64) + start))
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def signatures(keys: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """ProbMinHash of n documents: in each of ``size`` registers the shingle that arrived first; 0 where there is none."""
    first, held = np.full(n * size, np.inf), np.zeros(n * size, dtype=np.uint64)
    at, step = np.zeros(len(keys)), np.uint64(0)
    with np.errstate(over="ignore"):
        while len(keys):
            step += np.uint64(1)
            draw = mix(keys * _A + step * _C)
            at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights
            place = owner * size + (mix(draw + _B) % np.uint64(size)).astype(np.int64)
            np.minimum.at(first, place, at)
            won = first[place] == at
            held[place[won]] = keys[won]
            docs = np.unique(owner)
            last = np.zeros(n)
            last[docs] = first.reshape(n, size)[docs].max(axis=1)
            live = at < last[owner]
            keys, weights, owner, at = keys[live], weights[live], owner[live], at[live]
    return held.reshape(n, size)


def profile(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, and how often each occurs."""
    return np.unique(hashes, return_counts=True)


def alike(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two profiles."""
    (ka, ca), (kb, cb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    common, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if ca.max() == 1 == cb.max():
        return len(common) / (len(ka) + len(kb) - len(common))
    # a shingle of ratio r = y / x stands against the x of ratios up to r and the y of larger ones; one side's own have 0 and infinity
    ratio = cb[j] / ca[i]
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = ca[i][order], cb[j][order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    below = ca.sum() - x.sum() + np.append(0, np.cumsum(x))[upto]
    above = cb.sum() - np.append(0, np.cumsum(y))[upto]
    return float((1 / (below / x + above / y)).sum())


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two lists of shingles."""
    return alike(profile(a), profile(b))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, a, b, bands, sketch) of every row: a and b hash its words; without shingles all but the id are null."""
    size = BANDS * ROWS

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [word_ids(x or "") for x in batch.column(1).to_pylist()]
        held = signatures(*weighted([shingles(i) for i in ids]), len(ids), size)
        bands = np.zeros((len(ids), BANDS), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                bands = mix(bands * _A + held[:, r::ROWS])
            sketch = (mix(held) & np.uint64(255)).astype(np.uint8)
        content = [np.frombuffer(xxhash.xxh3_128_digest(i.tobytes()), dtype=np.int64) if len(i) else None for i in ids]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *[pa.array([None if c is None else int(c[k]) for c in content], pa.int64()) for k in (0, 1)],
                pa.array([_signed(b) if len(i) else None for b, i in zip(bands, ids, strict=True)], pa.list_(pa.int64())),
                pa.array([s.tobytes() if len(i) else None for s, i in zip(sketch, ids, strict=True)], pa.binary()),
            ],
            names=["id", "a", "b", "bands", "sketch"],
        )

    return df.select(F.col(doc_id).cast("long").alias("id"), text).mapInArrow(per_slice(run, 1), "id long, a long, b long, bands array<long>, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of (u, v) those whose texts are similar enough; texts: (id, text)."""
    left, right = texts.select(F.col("id").alias("u"), F.col("text").alias("t")), texts.select(F.col("id").alias("v"), F.col("text").alias("s"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def of(t: str) -> tuple[np.ndarray, np.ndarray]:
            if t not in seen:
                if len(seen) > 64:
                    seen.clear()
                seen[t] = profile(shingles(word_ids(t)))
            return seen[t]

        ok = [alike(of(t), of(s)) >= SIMILARITY for t, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(k) for k in (0, 1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    # a hub's stars are dealt to as many tasks as they fill, each with the hub's text; fewer than HOT hubs are of that kind
    limit = pairs.count() // HOT + 1
    hubs = F.broadcast(pairs.groupBy("v").agg(F.ceil(F.count("*") / limit).cast("int").alias("tasks")).where("tasks > 1"))
    dealt = pairs.join(hubs, "v", "left").withColumn("task", F.pmod(F.xxhash64("u"), F.coalesce("tasks", F.lit(1))).cast("int")).drop("tasks")
    spread = right.join(hubs, "v", "left").select("v", "s", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)).alias("task"))
    return dealt.join(left, "u").join(spread, ["v", "task"]).select("u", "v", "t", "s").mapInArrow(per_slice(run, 2), "u long, v long")


def _rest_links(members: DataFrame) -> DataFrame:
    """Members of mixed buckets -> links (u, v) that join their classes.

    members: bucket, id, component, sketch, bands, text; home: the class of the bucket's smallest member, which all have been
    compared with; n and n_rest: how many are in the bucket, and how many of them are of other classes than home.
    A pair is looked at in the first bucket that it shares, most alike by sketch first, and verified exactly unless links
    found in these blocks join it already; only links that join something are returned.
    """
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    here = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), blocks(n)).cast("int")
    common = ("bucket", "id", "component", "sketch", "bands", "text")
    rest = members.where("component <> home").select(*common, here("n_rest", 1).alias("l"), F.explode(F.sequence(F.lit(0), blocks("n") - 1)).alias("r"), F.lit(True).alias("rest"))
    every = members.select(*common, F.explode(F.sequence(F.lit(0), blocks("n_rest") - 1)).alias("l"), here("n", 2).alias("r"), F.lit(False).alias("rest"))

    def links(table: pa.Table) -> pa.Table:
        ids, comp, rest = (table[c].to_numpy(zero_copy_only=False) for c in ("id", "component", "rest"))
        codes = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1)
        bands = np.array(table["bands"].to_pylist(), dtype=np.int64).reshape(len(ids), -1)
        bucket, texts = table["bucket"][0].as_py(), table["text"].to_pylist()
        i, j = np.flatnonzero(rest), np.flatnonzero(~rest)
        found = []
        for k in i:
            estimate = (codes[j] == codes[k]).mean(axis=1)
            o = np.flatnonzero((estimate >= ESTIMATE) & (comp[j] != comp[k]))
            if len(o):
                first = (bands[j[o]] == bands[k]).argmax(axis=1)
                o = o[bands[k][first] == bucket]
                found += zip(estimate[o].tolist(), [k] * len(o), j[o].tolist(), strict=True)
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        profiles: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def of(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in profiles:
                profiles[k] = profile(shingles(word_ids(texts[k])))
            return profiles[k]

        out = []
        for _, k, o in sorted(found, key=lambda x: -x[0]):
            a, b = top(int(comp[k])), top(int(comp[o]))
            if a != b and alike(of(k), of(o)) >= SIMILARITY:
                parent[max(a, b)] = min(a, b)
                out.append((int(max(ids[k], ids[o])), int(min(ids[k], ids[o]))))
        return pa.table({"u": pa.array([x[0] for x in out], pa.int64()), "v": pa.array([x[1] for x in out], pa.int64())})

    return rest.unionByName(every).groupBy("bucket", "l", "r").applyInArrow(links, "u long, v long").distinct()


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``df`` with ``class_id``, the smallest id of its class, and ``kept``, whether it is that document."""
    rows = cut(fingerprints(df, doc_id, text))
    worded = rows.where("id IS NOT NULL AND a IS NOT NULL")
    same = cut(worded.groupBy("a", "b").agg(F.min("id").alias("node"), F.count("*").alias("many")))
    total = same.agg(F.sum("many")).first()[0] or 0
    # rows of the same words: a hot group is joined by a broadcast of its one node
    named = cut(join_hot(worded, same, ["a", "b"], total).select("id", "node", "bands", "sketch"))
    nodes = named.where("id = node").select("id", "bands", "sketch")
    buckets = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = cut(buckets.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("many")).where("least < most"))
    members = cut(join_hot(buckets, shared, ["bucket"], total * BANDS).select("bucket", "id", "least"))
    stars = cut(members.where("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct())
    wanted = stars.select(F.col("u").alias("id")).union(stars.select("v")).distinct()
    texts = cut(df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    links = cut(verified(stars, texts))
    found = components(links)
    of = lambda d: d.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    home = found.select(F.col("id").alias("least"), F.col("component").alias("home"))
    placed = of(members).join(home, "least", "left").withColumn("home", F.coalesce("home", "least"))
    outside = cut(placed.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("component") != F.col("home")).alias("n_rest")).where("n_rest > 0 AND n > 2"))
    in_mixed = outside.agg(F.sum("n")).first()[0] or 0
    mixed = join_hot(placed, outside, ["bucket"], in_mixed, "n").where("id <> least").join(nodes, "id").join(texts, "id")
    added = cut(_rest_links(mixed))
    final = components(links.unionByName(added)) if added.limit(1).count() else found
    # a row's node is the smallest id with its words, and an id stands for one document
    alias = named.where("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v"))
    linked = alias.join(final, alias.v == final.id, "left").select(F.col("u").alias("id"), F.coalesce("component", "v").alias("component"))
    rest = [c for c in df.columns if c not in ("class_id", "kept")]
    own, cls = fresh(df.select(*rest), "own", "class")
    lookup = final.unionByName(linked).groupBy(F.col("id").alias(own)).agg(F.min("component").alias(cls))
    out = df.select(*rest, F.col(doc_id).cast("long").alias(own)).join(lookup, own, "left")
    class_id = F.coalesce(cls, own)
    return out.select(*rest, class_id.alias("class_id"), F.coalesce(class_id == F.col(own), F.lit(True)).alias("kept"))
