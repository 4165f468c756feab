"""Spelling variants against a dictionary of deletions; the tree against plain loops."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartulary.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least=7):
    c = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                c[run] += 1
    return {w: n for w, n in c.items() if n >= 2}


def expected(n, ratio=10):
    patterns, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            patterns[i, less].add(w)
            if less in n:
                near[w].add(less)
                near[less].add(w)
    for some in patterns.values():
        for w in some:
            near[w] |= some - {w}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def got(df, **options):
    return {tuple(r) for r in spelling.variants(df, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_wavelet_reports_every_point_of_a_rectangle():
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 17, 200):
        values = rng.permutation(size)
        tree = spelling.Wavelet(values)
        low, high, least, most = (rng.integers(0, size + 1, 300) for _ in range(4))
        which, value = tree.report(low, high, least, most)
        want = sorted((q, v) for q in range(300) for v in values[low[q] : high[q]] if least[q] <= v < most[q])
        assert sorted(zip(which.tolist(), value.tolist(), strict=True)) == want


def some_words(rng, count):
    words = {"".join(rng.choice("abéÿ") for _ in range(rng.choice([7, 7, 8, 8, 9, 12]))) for _ in range(count)}
    for w in list(words)[: count // 2]:
        i = rng.randrange(len(w))
        words |= {w[:i] + w[i + 1 :], w[:i] + rng.choice("abz") + w[i:], w[:i] + "q" + w[i + 1 :], w + w[-1], w[0] + w}
    return {w: rng.choice([2, 2, 3, 5, 20, 25, 200, 2500]) for w in words if len(w) >= 7}


def test_random_words_and_blocks_that_are_cut(spark):
    n = some_words(random.Random(3), 300)
    df = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    want = expected(n)
    assert sum(w[1] is not None for w in want) > 30 and any(w[1] not in (None, w[2]) for w in want)
    assert got(df) == want
    # cut down to single places: still no pair lost or found twice
    assert got(df, limit=40) == want and got(df, limit=1) == want
    assert got(df, ratio=2) == expected(n, 2)


def test_one_block_of_most_words(spark):
    letters = "abcdefghij"
    n = {f"prefix{a}{b}{c}": 2 + (a == "a") * 40 for a in letters for b in letters for c in letters}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert got(df, limit=100) == expected(n)
    assert spelling.blocks(df, 100).groupBy("key").count().agg(F.max("count")).first()[0] <= 100


def test_words_of_documents(spark):
    rows = [(1, "Straße STRAßE straße, naïveté; naïveté don't under_score éÉÉéÉÉé éÉÉéÉÉé"), (2, None), (3, ""), (None, "nullword nullword nullword"), (4, "x" * 50_000 + " " + "x" * 50_000 + " " + "x" * 49_999 + " " + "x" * 49_999)]
    rows += [(i, "recieve receive receive receive international internationel") for i in range(5, 60)] + [(5, "recieve receive receive receive international internationel")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    n = counted(rows)
    words = spelling.vocabulary(df)
    assert {tuple(r) for r in words.collect()} == set(n.items()) and "straße" not in n
    assert got(words) == expected(n)


def test_empty_and_clashing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got(spelling.vocabulary(empty)) == set()
    one = spark.createDataFrame([("lonely words", 3, "mine", "x", 1)], "word string, n long, size string, key string, n_near long")
    assert got(one) == {("lonely words", None, "lonely words", 3, 0, None)}
    with pytest.raises(ValueError):
        spelling.variants(one, ratio=1)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.op13_spelling(spark, sf)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in found.collect()} == expected(counted(rows))
