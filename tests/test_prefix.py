"""Sums along one order, names of very many files, and numbers of lines in files that many tasks read."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cartulary.operators import metrics, prefix
from cartulary.plans import actions
from cartulary.sources import lines


def plain(rows, keyed):
    """(key, order, amount) -> with running sums, in Python."""
    sums, out = defaultdict(int), []
    for k, o, a in sorted(rows, key=lambda r: r[1]):
        sums[k if keyed else 0] += a or 0
        out.append((k, o, sums[k if keyed else 0]))
    return sorted(out, key=repr)


def some_rows(n):
    rng = random.Random(n)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(rng.choice(keys), o, rng.choice([None, 0, 1, 5, -3, 10**12])) for o in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize(("keys", "per_task"), [((), 10), (("key",), 10), (("key",), 300), (("key",), 10**6)])
def test_running_sums(spark, keys, per_task):
    rows = some_rows(700)
    df = spark.createDataFrame(rows, "key string, at long, n long").repartition(3)
    got = prefix.running(df, "at", "n", keys, "total", per_task)
    assert got.columns == ["key", "at", "n", "total"]
    found = [(r["key"], r["at"], r["total"] or 0) for r in got.collect()]
    assert sorted(found, key=repr) == plain(rows, keys)


def test_running_sums_of_nothing_and_of_decimals(spark):
    empty = spark.createDataFrame([], "key string, at long, n long")
    assert prefix.running(empty, "at", "n").count() == 0 and prefix.running(empty, "at", "n", ("key",)).count() == 0
    money = spark.range(200).select(F.col("id").alias("at"), (F.col("id") / 100).cast("decimal(10, 2)").alias("n"))
    assert str(prefix.running(money, "at", "n").agg(F.max("running")).first()[0]) == "199.00"


def test_no_task_sees_all_rows(spark):
    df = spark.range(5000).select(F.col("id").alias("at"), F.lit(1).cast("long").alias("n"))
    got = prefix.running(df, "at", "n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x]
    assert windows and all("_range" in x for x in windows)
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 5000 or len(sizes) == 1
    assert got.where("running <> at + 1").count() == 0


def test_running_cost_stops_where_one_order_passes_the_cap(spark):
    df = spark.createDataFrame([(i, 10) for i in range(50)], "at long, cents long").repartition(4)
    assert sorted(r["running"] for r in metrics.running_cost(df, "at", "cents", 95).collect()) == list(range(10, 101, 10))


# ---- names -----------------------------------------------------------------------------------------------------------


def named(rows, existing, mark="-"):
    """(folder, target, order, own) one after the other, each to the first free name."""
    split = lambda t: (t[: t.rindex(".")], t[t.rindex(".") :]) if "." in t[1:] else (t, "")
    taken, out, used = existing | {(f, t) for f, t, _, _ in rows}, {}, set()
    for f, t, o, own in sorted(rows, key=lambda r: r[2]):
        base, ext = split(t)
        stem, own_ext = split(own) if own else ("", "")
        head, _, tail = stem.rpartition(mark)
        if own and (own == t or (head == base and own_ext == ext and tail.isdigit() and tail[0] != "0")):
            out[o] = own
            continue
        if (f, t) not in existing and (f, t) not in used and not any(x[0] == f and x[1] == t and x[3] == t for x in rows):
            used.add((f, t))
            out[o] = t
            continue
        k = 1
        while (f, f"{base}{mark}{k}{ext}") in taken | used:
            k += 1
        used.add((f, f"{base}{mark}{k}{ext}"))
        out[o] = f"{base}{mark}{k}{ext}"
    return out


@pytest.mark.parametrize("per_task", [5, 10**6])
def test_names_are_free_and_first_come(spark, per_task):
    rng = random.Random(6)
    targets = ["a.pdf", "a-1.pdf", "a-3.pdf", "b.txt", "b-2.txt", "noext", ".hidden"]
    rows = [(rng.choice("xy"), rng.choice(targets[:1] * 5 + targets), i, None) for i in range(120)]
    existing = {("x", "a-2.pdf"), ("x", "a-5.pdf"), ("y", "a.pdf"), ("y", "noext-1"), ("x", "a-07.pdf")}
    df = spark.createDataFrame([r[:3] for r in rows], "folder string, target string, at long")
    there = spark.createDataFrame(sorted(existing), "folder string, name string")
    got = {r["at"]: r["new_name"] for r in actions.rename_all(df, "folder", "target", "at", there, per_task=per_task).collect()}
    assert got == named(rows, existing)
    pairs = [(r[0], got[r[2]]) for r in rows]
    assert len(set(pairs)) == len(pairs) and not set(pairs) & existing


def test_what_the_older_plan_gave_twice(spark):
    """a.pdf, a.pdf and a-1.pdf in one folder: three names."""
    df = spark.createDataFrame([("f", "a.pdf", 1), ("f", "a.pdf", 2), ("f", "a-1.pdf", 3)], "folder string, target string, at long")
    assert sorted(r["new_name"] for r in actions.rename_all(df, "folder", "target", "at").collect()) == ["a-1.pdf", "a-2.pdf", "a.pdf"]


def test_one_name_that_all_files_want(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("f").alias("folder"), F.lit("a.pdf").alias("target"), F.col("id").alias("at")).repartition(4)
    there = spark.range(1, 3 * n, 3).select(F.lit("f").alias("folder"), F.concat(F.lit("a-"), F.col("id").cast("string"), F.lit(".pdf")).alias("name"))
    got = actions.rename_all(df, "folder", "target", "at", there, per_task=1000).select("at", F.regexp_extract("new_name", "a-(.*).pdf", 1).alias("k"))
    free = [k for k in range(1, 3 * n) if k % 3 != 1]
    want = {0: "", **{i: str(free[i - 1]) for i in range(1, n)}}
    assert {r["at"]: r["k"] for r in got.collect()} == want


# ---- lines -----------------------------------------------------------------------------------------------------------


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "3000")
    spark.conf.set(names[1], "0")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def test_lines_are_numbered_through_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(2)
    want = {}
    for name in ("one.jsonl", "two.jsonl", "empty.jsonl"):
        text = [] if name == "empty.jsonl" else [rng.choice(["", "x", "é" * 50, "y" * 5000, "z\r"]) + str(i) * rng.randrange(3) for i in range(800)]
        (tmp_path / name).write_bytes("".join(x + "\n" for x in text).encode())
        want |= {(name, i): x for i, x in enumerate(text)}
    read = lines.numbered(spark, f"{tmp_path}/*.jsonl")
    assert spark.read.text(f"{tmp_path}/*.jsonl").rdd.getNumPartitions() > 20
    assert {(r["file"].rpartition("/")[2], r["line"]): r["raw"] for r in read.collect()} == want


def test_ground_truth_of_a_file_in_many_blocks(spark, tmp_path, small_blocks):
    good = [{"filename": f"{i % 700}.pdf", "domain": f"d{i}", "category": "c", "doctype": "t", "notes": "n" * 60} for i in range(2000)]
    text = [json.dumps(g) for g in good]
    text[5], text[1999], text[1000] = "{broken", '{"filename": "x.pdf"}', "# a note"
    path = tmp_path / "truth.jsonl"
    path.write_text("\n".join(text))
    last = {}
    for i, g in enumerate(good):
        if i not in (5, 1000, 1999):
            last[g["filename"]] = g["domain"]
    assert {r["filename"]: r["domain"] for r in lines.ground_truth(spark, str(path)).collect()} == last
    bad = {(r["number"], r["reason"]) for r in lines.bad_lines(spark, str(path)).collect()}
    assert bad == {(6, "no object"), (2000, "missing: domain, category, doctype")}
