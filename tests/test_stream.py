"""Streams: replayed batches, late copies, callers' functions; tokens as they come."""

import glob
import http.server
import json
import os
import random
import string
import sys
import threading
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cartulary import backends, calls, config, storage
from cartulary.classify import asker, invoke
from cartulary.streaming import landing

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GOOD = {"domain": "financial", "category": "banking", "doctype": "statement", "vendor": "Chase", "date": "20240115", "subject": "checking"}
SCHEMA = "path string, content string, error_code string, error_message string, time timestamp"


class Counted:
    def __init__(self, folder):
        self.folder = folder

    def answer(self, system, human):
        with open(os.path.join(self.folder, "told"), "a") as f:
            f.write("x")
        return json.dumps(GOOD)


def told(folder):
    path = os.path.join(folder, "told")
    return os.path.getsize(path) if os.path.exists(path) else 0


def arrive(spark, folder, names, minute):
    rows = [(n, f"text {n}", None, None) for n in names]
    docs = spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]).withColumn("time", F.to_timestamp(F.lit(f"2024-01-01 10:{minute:02d}:00")))
    docs.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def drain(spark, folder, on_batch=None):
    stream = landing.unique_within(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), "time")
    query = landing.classified(stream, f"{folder}/base", lambda p, m: lambda: Counted(str(folder)), on_batch=on_batch, width=2).trigger(availableNow=True).start()
    query.awaitTermination()


def test_copies_and_replays_cost_nothing(spark, tmp_path):
    seen = []
    arrive(spark, tmp_path, ["a", "b", "a"], 0)
    arrive(spark, tmp_path, ["b", "c"], 5)
    drain(spark, tmp_path, lambda results, number: seen.append((number, results.count())))
    assert told(tmp_path) == 3 and landing.results(spark, f"{tmp_path}/base").count() == 3 and sum(n for _, n in seen) == 3
    # the last batch is played again, as after a driver that was lost before the batch was committed
    commits = sorted((p for p in glob.glob(f"{tmp_path}/base/state/commits/*") if os.path.basename(p).isdigit()), key=lambda p: int(os.path.basename(p)))
    os.remove(commits[-1])
    for crc in glob.glob(f"{tmp_path}/base/state/commits/.{os.path.basename(commits[-1])}.crc"):
        os.remove(crc)
    before = list(seen)
    arrive(spark, tmp_path, ["c", "d"], 8)
    drain(spark, tmp_path, lambda results, number: seen.append((number, results.count())))
    assert told(tmp_path) == 4 and seen[: len(before)] == before and len({n for n, _ in seen}) == len(seen)
    assert sorted(r["original"] for r in landing.results(spark, f"{tmp_path}/base").collect()) == ["a", "b", "c", "d"]


def test_a_batch_that_failed_in_the_callers_function(spark, tmp_path):
    arrive(spark, tmp_path, ["a", "b"], 0)
    numbers = []

    def once(results, number):
        numbers.append(number)
        if len(numbers) == 1:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        drain(spark, tmp_path, once)
    assert told(tmp_path) == 2
    drain(spark, tmp_path, once)
    assert told(tmp_path) == 2 and numbers == [0, 0] and landing.results(spark, f"{tmp_path}/base").count() == 2


def shuffled(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    jvm = spark.sparkContext._jvm
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_of_a_batch_are_dealt_once_and_not_kept(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"{i}", "".join(rng.choice(string.printable[:94]) for _ in range(15_000)), None, None) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA.rsplit(",", 1)[0]).withColumn("time", F.to_timestamp(F.lit("2024-01-01 10:00:00")))
    docs.write.parquet(f"{tmp_path}/in")
    copies = lambda: set(glob.glob(f"{storage.shared_folder(spark).removeprefix('file://')}/held-*"))
    before, had = shuffled(spark), copies()
    drain(spark, tmp_path)
    assert landing.results(spark, f"{tmp_path}/base").count() == 60 and told(tmp_path) == 60
    assert shuffled(spark) - before < 1.5 * sum(len(r[1]) for r in rows)
    assert copies() == had and not [p for p in glob.glob(f"{tmp_path}/base/**/*.parquet", recursive=True) if os.path.getsize(p) > 100_000]


def test_equal_paths_of_a_stream_that_was_not_made_unique(spark, tmp_path):
    arrive(spark, tmp_path, ["a", "b", "a", "c", "b"], 0)
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    landing.classified(stream, f"{tmp_path}/base", lambda p, m: lambda: Counted(str(tmp_path)), width=2).trigger(availableNow=True).start().awaitTermination()
    assert told(tmp_path) == 3 and sorted(r["original"] for r in landing.results(spark, f"{tmp_path}/base").collect()) == ["a", "b", "c"]


# ---- tokens ----------------------------------------------------------------------------------------------------------


@pytest.fixture
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body.get("stream", False))
            text = json.dumps(GOOD)
            self.send_response(200)
            self.send_header("Content-Type", "application/json")
            if not body.get("stream"):
                data = json.dumps({"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 7, "completion_tokens": 5}, "message": {"content": text}}).encode()
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
                return
            self.end_headers()
            broken = "break" in json.dumps(body["messages"])
            for i, piece in enumerate(text[k : k + 10] for k in range(0, len(text), 10)):
                if broken and i == 2:
                    return
                self.wfile.write(b": still here\n\nevent: delta\ndata: " + json.dumps({"choices": [{"delta": {"content": piece}}]}).encode() + b"\n\n")
                self.wfile.flush()
                time.sleep(0.01)
            self.wfile.write(b"data: [DONE]\n\ndata: {}\n\n")

        def log_message(self, *args):
            pass

    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked
    made.shutdown()


def client(url, monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    return backends.Http(config.Settings(provider="openai", model="m"), url)


def test_tokens_come_before_the_answer_that_counts(server, monkeypatch):
    url, asked = server
    http_client, tokens = client(url, monkeypatch), []
    got = asker(lambda p, m: lambda: http_client, on_token=tokens.append)("text")
    assert json.loads(got.answer.text) == GOOD and "".join(tokens) == json.dumps(GOOD) and len(tokens) > 5 and asked == [True, False]


def test_a_stream_that_breaks_off_or_a_sink_that_fails_changes_nothing(server, monkeypatch):
    url, asked = server
    http_client, tokens = client(url, monkeypatch), []
    assert json.loads(asker(lambda p, m: lambda: http_client, on_token=tokens.append)("break").answer.text) == GOOD and 0 < len(tokens) < 5

    def failing(token):
        raise OSError("full")

    assert json.loads(asker(lambda p, m: lambda: http_client, on_token=failing)("text").answer.text) == GOOD
    assert asker(lambda p, m: lambda: Plain(), on_token=failing)("text").answer.text == "plain"


class Plain:
    def answer(self, system, human):
        return "plain"


def test_tokens_in_partitions(spark, server, monkeypatch, tmp_path):
    url, _ = server
    http_client, path = client(url, monkeypatch), str(tmp_path / "tokens")

    def sink(token):
        with open(path, "a") as f:
            f.write(token)

    docs = spark.createDataFrame([(f"{i}", "text", None, None) for i in range(3)], "path string, content string, error_code string, error_message string").coalesce(1)
    rows = invoke(docs, lambda: http_client, on_token=sink).collect()
    assert all(json.loads(r["response"]) == GOOD for r in rows) and open(path).read() == 3 * json.dumps(GOOD)


def test_events_of_other_forms():
    lines = [b'{"message": {"content": "a"}}\n', b"data: [1]\n", b"data: {bad\n", b'data: {"delta": {"partial_json": "b"}}\n', b"data: [DONE]\n", b'{"x": 1}\n']
    assert list(backends.events(lines)) == [{"message": {"content": "a"}}, {"delta": {"partial_json": "b"}}]
    assert backends._local_token({"message": {"content": "a"}}) == "a" and backends._tool_token({"delta": {"partial_json": "b"}}) == "b" and backends._chat_token({"choices": []}) is None


def test_calls_of_a_stream_are_a_log(spark, tmp_path):
    arrive(spark, tmp_path, ["a"], 0)
    drain(spark, tmp_path)
    assert calls.read(spark, f"{tmp_path}/base/calls").first()["document"] == "a"
