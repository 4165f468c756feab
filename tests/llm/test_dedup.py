"""Suffix, embedding and MinHash near duplicates against brute force, and their edge cases."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from cartulary.llm import components, embedding_dedup, minhash, suffix_dedup

DOC = "doc_id long, text string"


# ---- suffix arrays ---------------------------------------------------------------------------------------------------


def test_suffix_ranks_match_sorted_suffixes():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randint(1, rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 80))]
        order = sorted(range(len(s)), key=lambda i: s[i:])
        ranks = np.empty(len(s), dtype=int)
        ranks[order] = np.arange(len(s))
        assert (suffix_dedup.suffix_ranks(np.array(s, dtype=np.uint64), depth=10**6).astype(int) == ranks).all()


def test_suffix_ranks_of_a_wide_alphabet():
    """Names of triples beyond 64 bits."""
    s = np.random.default_rng(1).integers(1, 1 << 23, 5000).astype(np.uint64)
    order = np.argsort(suffix_dedup.suffix_ranks(s, depth=10**6))
    suffixes = [tuple(s[i : i + 4].tolist()) for i in order]
    assert suffixes == sorted(suffixes)


def repeats(docs, size=100):
    """(id, text) in order -> id: (bytes, removed, spans, kept)."""
    seen, out = set(), {}
    for d, text in docs:
        t = (text or "").encode()
        cover, new = np.zeros(len(t), dtype=bool), []
        for i in range(len(t) - size + 1):
            w = t[i : i + size]
            if w in seen:
                cover[i : i + size] = True
            else:
                seen.add(w)
        spans = int(np.diff(np.concatenate(([False], cover)).astype(int)).clip(0).sum())
        out[d] = (len(t), int(cover.sum()), spans, np.frombuffer(t, np.uint8)[~cover].tobytes())
    return out


def removed(spark, docs, schema=DOC):
    rows = suffix_dedup.dedup(spark.createDataFrame(docs, schema)).collect()
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows}


def test_suffix_dedup_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(60)) for _ in range(6)]
    docs = []
    for d in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passage)
            a = rng.randint(0, 80)
            parts += [p[a : a + rng.randint(50, 260)], " ".join(word() for _ in range(rng.randint(0, 20)))]
        docs.append((d, "".join(parts)))
    docs += [(200, "z" * 1000), (201, "z" * 350), (202, "ab" * 300), (203, docs[3][1]), (204, "y" * 99), (205, "y" * 99), (206, None), (207, ""), (208, "x" + passage[0])]
    monkeypatch.setattr(suffix_dedup, "SHARD", 4000)
    assert removed(spark, docs) == repeats(docs)


def test_suffix_dedup_edges(spark):
    same = "some text that is long enough to hold a window of one hundred bytes, and a little more than that, surely so."
    frame = spark.createDataFrame([(1, same, "a"), (1, same, "b"), (2, same, "c"), (None, same, "d"), (3, None, "e")], DOC + ", bucket string")
    rows = suffix_dedup.dedup(frame).collect()
    assert {(r["doc_id"], r["bucket"]): r["n_removed"] for r in rows} == {(1, "a"): len(same), (1, "b"): len(same), (2, "c"): len(same), (None, "d"): 0, (3, "e"): 0}
    assert suffix_dedup.dedup(frame.limit(0)).count() == 0


def test_suffix_dedup_of_repeated_rows_in_other_partitions(spark):
    rng = random.Random(8)
    one, two = ("".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(2))
    docs = [(1, one), (2, one[:250] + two[:150]), (3, two + two[50:300])]
    rows = spark.sparkContext.parallelize(docs * 4, 12).toDF(DOC)
    got = suffix_dedup.dedup(rows).collect()
    want = repeats(docs)
    assert len(got) == 12 and all((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]] for r in got)


def test_unlike_slices_that_agree_in_a_part_of_their_hashes_stay_open(monkeypatch):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, anchors = text(600), suffix_dedup.anchors
    docs = [(d, text(200) + passage + text(200)) for d in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["d", "text"])

    def spans():
        found = pa.Table.from_batches(list(suffix_dedup._find_anchors(1)(iter([batch]))))
        out = suffix_dedup._compare_slices(1)(found)
        blobs = [b for k, b in zip(out["kind"].to_pylist(), out["blob"].to_pylist(), strict=True) if k == 1]
        got, _ = suffix_dedup.unpack("span", blobs)
        return sorted(zip(*(got[f].tolist() for f in ("d", "s", "e")), strict=True))

    want = spans()
    assert want and all(docs[d][1][s:e] in passage for d, s, e in want)
    for bits in (40, 0):  # of the first hash only its upper 24 bits differ, or none
        cut = np.uint64((1 << 64) - (1 << bits) if bits else 0)
        monkeypatch.setattr(suffix_dedup, "anchors", lambda texts, cut=cut: (x := anchors(texts)) | {"c": x["c"] & cut})
        assert spans() == want


# ---- connected components --------------------------------------------------------------------------------------------


def roots(edges):
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    frame = spark.createDataFrame([*edges, (5, 5), (7, None)], "u long, v long")
    got = {r["id"]: r["component"] for r in components.components(frame).collect()}
    assert got == {k: v for k, v in roots([e for e in edges if e[0] != e[1]]).items()}
    assert components.components(frame.limit(0)).count() == 0


# ---- embeddings ------------------------------------------------------------------------------------------------------


def test_embeddings_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        v = base[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 0.3)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 2)))
    rows += [(500, rows[3][1], rows[3][2]), (501, rows[3][1], rows[3][2]), (502, rows[3][1], 1 - rows[3][2])]
    monkeypatch.setattr(embedding_dedup, "BLOCK", 50)
    monkeypatch.setattr(embedding_dedup, "DEAL", 500)
    got = embedding_dedup.classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    links, edges = collections.Counter(), []
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][2] == rows[b][2] and unit[rows[a][0]] @ unit[rows[b][0]] >= embedding_dedup.LIMIT:
                edges.append((rows[a][0], rows[b][0]))
                links.update(edges[-1])
    root = roots(edges)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got} == {i: (links[i], root.get(i, i), root.get(i, i) == i) for i, _, _ in rows}
    assert sum(links.values()) > 1000


def test_embedding_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, 9), (2, [2.0, 0.0], 1, 9), (3, [0.0, 0.0], 1, 9), (4, None, 1, 9), (5, [1.0, None], 1, 9), (6, [nan, 1.0], 1, 9), (7, [inf, 1.0], 1, 9), (8, [1.0, 0.0], None, 9), (9, [1.0], 1, 9), (None, [1.0, 0.0], 1, 9), (2, [2.0, 0.0], 1, 9), (10, [], 1, 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n long")
    got = embedding_dedup.classes(frame).collect()
    assert len(got) == 12 and all(r["n"] == 9 for r in got)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(1, 1, 1), (2, 1, 1), (None, 0, None)} | {(i, 0, i) for i in range(3, 11)}
    assert embedding_dedup.classes(frame.limit(0)).count() == 0


# ---- ProbMinHash -----------------------------------------------------------------------------------------------------


def plain_similarity(x, y):
    x, y = collections.Counter(x), collections.Counter(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in set(x) | set(y)) for i in x if i in y)


def test_similarity_and_estimate():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x, y = rng.integers(0, 12, rng.integers(1, 30)), rng.integers(0, 12, rng.integers(1, 30))
        assert minhash.similarity(x.astype(np.uint64), y.astype(np.uint64)) == pytest.approx(plain_similarity(x.tolist(), y.tolist()))
    a = rng.integers(1, 1 << 63, 300, dtype=np.uint64)
    a = np.concatenate((a, a[:90], a[:20]))
    b = np.concatenate((a[40:300], rng.integers(1, 1 << 63, 30, dtype=np.uint64)))
    held = minhash.signatures(*minhash.weighted([a, b]), 2, 4000)
    assert (held[0] == held[1]).mean() == pytest.approx(minhash.similarity(a, b), abs=0.04)


def near_copies(rng, n):
    docs, word = [], lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 60))
    for _ in range(n):
        words = [word() for _ in range(rng.randint(20, 160))]
        docs.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 4])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 5, 9])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_minhash_classes_equal_brute_force(spark):
    docs = near_copies(random.Random(8), 150)
    found = {d: minhash.shingles(minhash.word_ids(t)) for d, t in docs}
    edges = [(a, b) for a in found for b in range(a) if len(np.intersect1d(found[a], found[b])) and minhash.similarity(found[a], found[b]) >= minhash.SIMILARITY]
    root = roots(edges)
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in minhash.classes(spark.createDataFrame(docs, DOC)).collect()}
    assert got == {d: (root.get(d, d), root.get(d, d) == d) for d, _ in docs} and len(edges) > 50


def test_members_of_mixed_buckets_are_compared(spark):
    """Of the bucket's members outside the smallest one's class two are alike, one only by its sketch."""
    like, far = bytes(range(150)), bytes([255] * 150)
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(5, 5, like, words), (6, 6, like, words + " more"), (7, 7, far, words), (8, 8, like, "nothing like the others at all")]
    frame = spark.createDataFrame([(0, i, c, s, [0, 1, 2], t, 2, 4, 4) for i, c, s, t in rows], "bucket long, id long, component long, sketch binary, bands array<long>, text string, home long, n long, n_rest long")
    assert [tuple(r) for r in minhash._rest_links(frame).collect()] == [(6, 5)]
    elsewhere = frame.withColumn("bucket", frame.bucket + 1)
    assert minhash._rest_links(elsewhere).count() == 0


def test_minhash_edges(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, 0), (2, text, 0), (3, text.replace(" ", "\n"), 0), (4, None, 0), (5, "", 0), (6, " \n ", 0), (7, "short text", 0), (8, "short text", 0), (None, text, 0), (2, text, 0), (9, "word " * 20_000, 0)]
    frame = spark.createDataFrame(rows, DOC + ", id long")
    got = minhash.classes(frame).collect()
    assert len(got) == 11 and all(r["id"] == 0 for r in got)
    assert {(r["doc_id"], r["class_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 7), (None, None), (9, 9)}
    assert minhash.classes(frame.limit(0)).count() == 0


def test_similar_by_one_word(spark):
    words = [f"w{i}" for i in range(120)]
    other = [*words[:60], "changed", *words[61:]]
    far = [f"v{i}" for i in range(120)]
    got = {r["doc_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame([(10, " ".join(words)), (11, " ".join(other)), (12, " ".join(far))], DOC)).collect()}
    assert got == {10: 10, 11: 10, 12: 12}
