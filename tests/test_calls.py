"""Open calls, the stop of a whole job, and the log: what ends is kept, what is kept isn't asked again."""

import glob
import json
import os
import signal
import subprocess
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cartulary import calls, cli
from cartulary.backends import Answer, ApiError
from cartulary.classify import asker, classify, invoke, outcome
from cartulary.operators import experiments

# workers do not see the tests' folder
cloudpickle.register_pickle_by_value(sys.modules[__name__])

GOOD = {"domain": "financial", "category": "banking", "doctype": "statement", "vendor": "Chase", "date": "20240115", "subject": "checking"}
SCHEMA = "path string, content string, error_code string, error_message string"


class Counted:
    """Leaves a line for each call as it begins and as it ends; some documents fail, some are busy at first."""

    def __init__(self, folder, wait=0.0):
        self.folder, self.wait = folder, wait

    def tell(self, sign):
        fd = os.open(os.path.join(self.folder, "told"), os.O_WRONLY | os.O_APPEND | os.O_CREAT)
        os.write(fd, f"{sign}\n".encode())
        os.close(fd)

    def answer(self, system, human):
        self.tell("+")
        time.sleep(self.wait)
        self.tell("-")
        if "refuse" in human:
            raise ApiError("refused")
        return Answer(json.dumps(GOOD), 10, 5)


def told(folder):
    path = os.path.join(folder, "told")
    return open(path).read().split() if os.path.exists(path) else []


def most_open(signs):
    now = most = 0
    for s in signs:
        now += 1 if s == "+" else -1
        most = max(most, now)
    return most


def documents(spark, n, bad=(), parts=1):
    rows = [(f"{i:03d}.txt", f"refuse {i}" if i in bad else f"text {i}", None, None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartitionByRange(parts, "path") if parts > 1 else spark.createDataFrame(rows, SCHEMA).coalesce(1)


# ---- within a partition ----------------------------------------------------------------------------------------------


def test_one_partition_keeps_several_calls_open(spark, tmp_path):
    folder = str(tmp_path)
    docs = documents(spark, 24, bad={3, 17}).unionByName(spark.createDataFrame([("lost", None, "DOCUMENT_LOAD_FAILED", "x")], SCHEMA)).coalesce(1)
    rows = invoke(docs, lambda: Counted(folder, 0.15), width=6).collect()
    signs = told(folder)
    assert signs.count("+") == 24 and most_open(signs) == 6
    codes = {r["path"]: r["error_code"] for r in rows}
    assert len(rows) == 25 and codes["003.txt"] == codes["017.txt"] == "LLM_API_ERROR" and codes["lost"] == "DOCUMENT_LOAD_FAILED"
    assert sum(c is None for c in codes.values()) == 22 and all(r["total_tokens"] == 15 for r in rows if r["error_code"] is None)
    assert min(r["latency_ms"] for r in rows if r["path"] != "lost") >= 140


def test_columns_and_nulls_pass_through_a_pool(spark, tmp_path):
    folder = str(tmp_path)
    docs = documents(spark, 5).withColumns({"n": F.when(F.col("path") != "002.txt", F.lit(7)), "extra": F.array(F.lit("a"))})
    rows = invoke(docs, lambda: Counted(folder), width=3, debug=True).orderBy("path").collect()
    assert [r["n"] for r in rows] == [7, 7, None, 7, 7] and rows[0]["extra"] == ["a"] and "text 4" in rows[4]["prompt"]


def test_short_calls_stay_in_their_thread_and_long_ones_do_not():
    def ask(i):
        time.sleep(0.05 * (i >= 200))
        return calls.Outcome(Answer(str(threading.get_ident() == here)))

    here = threading.get_ident()
    got = {i: out.answer.text == "True" for i, out in calls.pooled(iter(range(240)), ask, 4)}
    assert len(got) == 240 and sum(got[i] for i in range(200)) > 100 and sum(got[i] for i in range(200, 240)) <= 2


def test_answers_come_as_calls_end_and_rows_wait():
    taken, gate = [], threading.Event()

    def rows():
        for i in range(100):
            taken.append(i)
            yield i

    def ask(i):
        if i == 0:
            gate.wait(10)
        return calls.Outcome(Answer(str(i)))

    ended = calls.pooled(rows(), ask, 4)
    first = [next(ended)[0] for _ in range(20)]
    # the first row is still open, and no more rows were taken than there was room for
    assert 0 not in first and len(taken) <= 20 + 4 + 1
    gate.set()
    assert sorted(first + [r for r, _ in ended]) == list(range(100))


def test_classification_through_a_pool(spark, tmp_path):
    rows = classify(documents(spark, 6, bad={1}), lambda: Counted(str(tmp_path)), width=3).collect()
    assert sum(r["error"] for r in rows) == 1 and {r["domain"] for r in rows} == {"financial", None}


# ---- stop ------------------------------------------------------------------------------------------------------------


def test_one_failure_stops_every_partition(spark, tmp_path):
    folder = str(tmp_path)
    docs = documents(spark, 160, bad={0}, parts=8)
    assert docs.rdd.getNumPartitions() == 8
    kept, _ = _held(spark, classify(docs, lambda: Counted(folder, 0.1), stop=True), tmp_path)
    assert told(folder).count("+") < 80
    assert kept.count() == 160 and outcome(kept, "fail") == 2
    said = {r[0] for r in kept.select("error_message").distinct().collect()}
    assert "refused" in said and any(x and x.startswith("not tried") for x in said)


def _held(spark, df, tmp_path):
    path = str(tmp_path / "held")
    df.write.parquet(path)
    return spark.read.parquet(path), path


def test_a_stopped_log_keeps_what_ended(spark, tmp_path):
    folder, log = str(tmp_path), str(tmp_path / "log")
    docs = documents(spark, 120, bad={0}, parts=8).withColumnRenamed("path", "document")
    models = spark.createDataFrame([("p", "m")], "provider string, model string")
    ask = asker(lambda p, m: lambda: Counted(folder, 0.1))
    first = calls.log(docs, models, log, ask, width=2, stop=True)
    made = told(folder).count("+")
    assert 0 < first.count() == made < 60
    assert first.where("error_code IS NOT NULL").count() == 1
    # the rest is asked for later, and nothing twice
    second = calls.log(docs, models, log, ask, width=4)
    assert second.count() == 120 and told(folder).count("+") == 120
    # failures only on demand
    assert calls.log(docs, models, log, ask, again=True).count() == 120 and told(folder).count("+") == 121


# ---- the log ---------------------------------------------------------------------------------------------------------


def test_log_by_model_and_lines_that_were_cut(spark, tmp_path):
    log = str(tmp_path / "log")
    docs = documents(spark, 10).withColumnRenamed("path", "document")
    models = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "provider string, model string")

    class Named:
        def __init__(self, name):
            self.name = name

        def answer(self, system, human):
            return self.name

    ask = asker(lambda p, m: lambda: Named(f"{p}/{m}"))
    got = calls.log(docs, models, log, ask, width=3, roll=4)
    assert got.count() == 30 and all(r["response"] == f"{r['provider']}/{r['model']}" for r in got.collect())
    files = sorted(glob.glob(f"{log}/calls-*.jsonl"))
    assert len(files) >= 8
    whole = open(files[0]).read()
    open(files[0], "w").write(whole[: len(whole) - 25])
    assert calls.read(spark, log).count() == 29
    assert calls.log(docs, models, log, ask).count() == 30
    assert calls.read(spark, str(tmp_path / "none")).count() == 0


def test_an_attempt_goes_on_where_another_one_was_lost(spark, tmp_path):
    """A task that dies after some calls is run again; what it had logged is not asked again."""
    folder, log = str(tmp_path), str(tmp_path / "log")
    os.makedirs(log)
    with open(f"{log}/calls-run1-000000-000-aaaa-0000.jsonl", "w") as f:
        f.write(json.dumps({"document": "000.txt", "provider": "p", "model": "m", "ended": "1"}) + '\n{"document": "001')
    system, path = calls.opened(log)
    assert calls._keys_in(system, path, "calls-run1-000000-") == {("000.txt", "p", "m")}
    assert calls._keys_in(system, path, "calls-run1-000001-") == set() and calls._keys_in(system, path + "/no", "calls-") == set()


SCRIPT = """
import sys, time
sys.path[:0] = [{repo!r}, {tests!r}]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {folder!r} + "/w").config("spark.checkpoint.dir", "file://" + {folder!r} + "/c").getOrCreate()
from test_calls import Counted, documents
from cartulary import calls
from cartulary.classify import asker
docs = documents(spark, 40, parts=4).withColumnRenamed("path", "document")
models = spark.createDataFrame([("p", "m")], "provider string, model string")
calls.log(docs, models, {folder!r} + "/log", asker(lambda p, m: lambda: Counted({folder!r}, 0.25)), width=2)
"""


def test_a_killed_run_is_resumed_without_a_second_call(spark, tmp_path):
    folder, here = str(tmp_path), os.path.dirname(os.path.abspath(__file__))
    code = SCRIPT.format(repo=os.path.dirname(here), tests=here, folder=folder)
    paths = os.pathsep.join([os.path.dirname(here), here, os.environ.get("PYTHONPATH", "")])
    run = subprocess.Popen([sys.executable, "-c", code], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True, env=os.environ | {"PYTHONPATH": paths})
    began = time.time()
    while told(folder).count("-") < 9 and time.time() - began < 120:
        time.sleep(0.05)
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    time.sleep(1)
    ended, before = calls.read(spark, folder + "/log").count(), told(folder).count("+")
    assert 4 <= ended < 40
    docs = documents(spark, 40, parts=4).withColumnRenamed("path", "document")
    models = spark.createDataFrame([("p", "m")], "provider string, model string")
    got = calls.log(docs, models, folder + "/log", asker(lambda p, m: lambda: Counted(folder)), width=2)
    # only the few calls that were open when all was killed are made again
    assert got.count() == 40 and told(folder).count("+") - before == 40 - ended and before - ended <= 8


def test_experiment_command_goes_on(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    for i in range(4):
        (tmp_path / f"{i}.txt").write_text("refuse this" if i == 2 else "financial banking statement")
    manifest = {"name": "e", "models": [{"provider": "ollama", "model": "m"}, {"provider": "openai", "model": "n"}], "documents": [{"path": str(tmp_path / f"{i}.txt"), "expected": GOOD | {"doctype": "statements"}} for i in range(4)]}
    path, out = tmp_path / "e.json", tmp_path / "out.jsonl"
    path.write_text(json.dumps(manifest))
    monkeypatch.setattr(cli, "_maker", lambda args, s: lambda: Counted(folder))
    argv = ["experiment-run", str(path), "--output", str(out), "--concurrency", "6"]
    assert cli.main(argv, spark) == 1 and told(folder).count("+") == 8
    assert cli.main(argv, spark) == 1 and told(folder).count("+") == 8
    manifest["models"].append({"provider": "openai", "model": "o"})
    path.write_text(json.dumps(manifest))
    assert cli.main(argv, spark) == 1 and told(folder).count("+") == 12
    assert cli.main([*argv, "--retry-failed"], spark) == 1 and told(folder).count("+") == 15
    assert experiments.summary(spark.read.json(str(out))).first()["total"] == 12


@pytest.mark.parametrize("uri", ["/tmp/x", "file:/tmp/x", "file:///tmp/x"])
def test_folders_as_workers_see_them(uri):
    assert calls.opened(uri)[1] == "/tmp/x"
