"""Line dedup against a plain version; its SQL over whole tables is in the driver's comparison and below."""

import hashlib
import random
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from cartulary.llm import line_dedup, oracles, queries

SCHEMA = "doc_id long, text string"
SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)


def plain(rows, least_chars=20, least_docs=3):
    key = lambda line: line.strip(SPACE).translate(LOWER)
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(doc)
    first = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = [key(x) in first and first[key(x)] != doc for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup(df, **options).collect()), key=repr)


def made(rng, docs, lines):
    pool = [f"A common line number {i} OF MANY" for i in range(6)] + ["short", "", "  ", "É" * 19, "É" * 20, "x" * 19 + "\xa0"]
    some = lambda: rng.choice(pool) if rng.random() < 0.6 else f"its own line {rng.random()} and more"
    dress = lambda x: rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.2 else x) + rng.choice(["", "  ", "\x0b", "\x0c"])
    return [(i, "\n".join(dress(some()) for _ in range(rng.randrange(lines)))) for i in range(docs)]


def test_random_documents(spark):
    rng = random.Random(4)
    rows = [*made(rng, 40, 12), (None, "A common line number 1 OF MANY\nand\n"), (None, None), (50, ""), (51, None), (3, "A common line number 2 OF MANY"), (3, "A common line number 2 OF MANY")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(df) == plain(rows)
    # no key is hot, every repeated one is, some are
    assert got(df, hot=1) == plain(rows) and got(df, hot=10**9) == plain(rows) and got(df, hot=20) == plain(rows)
    assert got(df, least_chars=1, least_docs=2) == plain(rows, 1, 2)


def test_long_document_and_bitmap(spark):
    common = "this line stands in every document"
    long = "\n".join(common if i % 3 == 0 else f"a line of its own, number {i}" for i in range(5000))
    rows = [(1, long), (2, common), (3, common)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == plain(rows)
    r = line_dedup.dedup(df).where("doc_id = 1").first()
    off = {64 * w["word"] + b for w in r["keep"] for b in range(64) if not (w["bits"] >> b) & 1}
    assert off == set(range(0, 5000, 3)) and r["n_dropped"] == len(off)
    assert line_dedup.dedup(df).where("doc_id = 3").first()["keep"] is None


def test_hot_line_of_most_rows(spark):
    rows = [(i, "the one line that everybody has\n" * 3 + f"an own line of document {i}") for i in range(500)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(df) == plain(rows) and got(df, hot=10) == plain(rows)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert line_dedup.dedup(empty).collect() == []
    df = spark.createDataFrame([(i, "the same long enough line\nx") for i in range(4)], SCHEMA)
    odd = ("row", "t", "doc", "_doc", "_row", "h1", "H2", "at", "word", "bits", "lines")
    out = line_dedup.dedup(df.withColumns({c: F.lit(f"mine {c}") for c in odd} | {"KEEP": F.lit("old"), "n_lines": F.lit("old")}))
    rows = out.collect()
    assert len(rows) == 4 and all(r[c] == f"mine {c}" for r in rows for c in odd)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"]) for r in rows) == [(0, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 0)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duck.execute(oracles.LINE_DEDUP_SQL).fetchall())
    assert sorted(map(tuple, queries.op12_line_dedup(spark, sf).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())) == want
    texts = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert sorted((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in plain(texts)) == want


def test_plan_deals_lines_once_and_runs_no_python(spark):
    found = line_dedup.lines(spark.createDataFrame([(i, "a line that is long enough") for i in range(9)], SCHEMA), "text", "doc_id", 20)
    plan = line_dedup.dropped(found, 3)._jdf.queryExecution().executedPlan().toString()
    cool = plan[: plan.index("Union") + 1] if plan.index("Union") > 9999 else plan
    assert "rangepartitioning(h1" in cool and "Python" not in plan and "Arrow" not in plan
    # the window takes the ranges as they are: nothing is dealt by hash(h1, h2) above the range exchange
    window = plan[plan.index("Window") : plan.index("rangepartitioning(h1")]
    assert "hashpartitioning" not in window
