"""The corpus pipeline: every stage's contract, and the whole against its stages' rules."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cartulary.llm import mixing, pii

COLUMNS = list(corpus_pipeline.COLUMNS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("ka lo mi re tu sa ne vo pi du".split()) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(300):
        words = [word() for _ in range(rng.randint(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grumbolt", "snarfik"]))
        labels.append((i, 1, int(toxic)))
        docs.append((i, " ".join(words)))
    docs += [(400 + k, docs[k][1]) for k in (1, 2, 3)] + [(500, docs[5][1] + " mail a@b.co"), (600, None), (601, ""), (1, docs[1][1]), (None, "no id here")]
    folder = tmp_path_factory.mktemp("small")
    rows = [(d, t, "en", f"s{(d or 0) % 3}", len(t or ""), "x") for d, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs


def test_stages(spark, small, tmp_path):
    folder, docs = small
    held, before = spark.read.parquet(f"{folder}/documents.parquet"), len(docs)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == COLUMNS, name
        out.write.parquet(f"{tmp_path}/{k}")
        held = spark.read.parquet(f"{tmp_path}/{k}")
        ids = [r[0] for r in held.select("doc_id").collect()]
        if name == "toxicity":
            assert len(ids) < before and {400, 401, 402, 403, 600, 601} & set(ids) >= {401, 402, 403, 600, 601} and None in ids
            kept = {i for i in ids if i is not None and i < 300}
            assert len({i for i in range(300) if i % 4} - kept) <= 5 and len(kept & set(range(0, 300, 4))) <= 15
        elif name == "near_duplicates":
            assert len(ids) == len(set(ids)) and not {401, 402, 403, 500} & set(ids) and {1, 2, 3, 5, 600, 601} <= set(ids)
        else:
            assert len(ids) == last  # noqa: F821
        if name == "personal_data":
            assert all(not pii.base_spans(r["text"] or "") and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in held.collect())
        last = len(ids)  # noqa: F841


def test_run_and_empty_tables(spark, small, tmp_path):
    folder, _ = small
    assert corpus_pipeline.run(spark, folder).where("n_tokens >= 0").count() > 200
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def plain_pfair(counts):
    """The source of every row: earliest deadline first among the released blocks, anew whenever a source has run out."""
    names, weights, left = sorted(counts), mixing.default_weights(counts), dict(counts)
    out = []
    while any(left.values()):
        held = [s for s in names if left[s]]
        period, done, t = sum(weights[s] for s in held), dict.fromkeys(held, 0), 0
        while all(left[s] for s in held):
            released = [s for s in held if done[s] * period // weights[s] <= t]
            s = min(released, key=lambda s: (-(-(done[s] + 1) * period // weights[s]), s))
            n = min(mixing.BLOCK, left[s])
            out += [s] * n
            left[s], done[s], t = left[s] - n, done[s] + 1, t + 1
    return out


def test_rows_follow_the_schedule(spark, small):
    folder, _ = small
    documents = spark.read.parquet(f"{folder}/documents.parquet").withColumn("source", F.expr("CASE WHEN doc_id % 7 = 0 THEN 'rare' ELSE source END"))
    scattered = documents.repartition(7)
    for docs in (documents, scattered):
        rows = corpus_pipeline.encode(spark, docs, folder).collect()
        assert [r["source"] for r in rows] == plain_pfair(collections.Counter(r["source"] for r in rows))
        assert [r["place"] for r in rows] == sorted({r["place"] for r in rows})
    rows = corpus_pipeline.run(spark, folder).collect()
    assert [r["source"] for r in rows] == plain_pfair(collections.Counter(r["source"] for r in rows))
    assert [r["place"] for r in rows] == sorted({r["place"] for r in rows})


def test_near_copies_of_repeated_and_null_ids(spark):
    rng = random.Random(4)
    a, b, c = (" ".join(rng.choice("ka lo mi re tu sa ne vo pi du".split()) + str(rng.randrange(40)) for _ in range(80)) for _ in range(3))
    docs = [(7, a), (7, b), (7, b), (8, a), (None, a), (None, c), (None, c), (9, b + " more"), (10, None), (11, ""), (None, None)]
    rows = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x") for d, t in docs], SCHEMA)
    out = corpus_pipeline.drop_near_copies(spark, rows, "")
    assert out.columns == COLUMNS
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == collections.Counter([(7, a), (7, b), (None, c), (10, None), (11, ""), (None, None)])
