"""Calls to models from within partitions: several open at once, one stop for all tasks, and a log of each as it ends.

A model takes seconds where everything else takes microseconds, so calls are what a job waits for, pays for and must not
lose.  A partition keeps up to ``width`` calls open and hands answers on as they end, in any order; it holds no more rows than that.
The log is a sink: ``documents.write.format(...)`` asks, and every answer is a line of JSON on its way to the shared folder
before the next one is awaited.  What a killed job had finished is there, and a later one asks only for the rest.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from queue import Empty, SimpleQueue

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cartulary.backends import TRANSIENT, Answer

TOKENS = ("input_tokens", "output_tokens", "total_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
KEYS = ("document", "provider", "model")
RECORD = ", ".join(f"{k} string" for k in KEYS) + ", response string, error_code string, error_message string, latency_ms double, " + ", ".join(f"{t} long" for t in TOKENS) + ", ended string"
NOT_TRIED = ("UNEXPECTED_ERROR", "not tried: another document failed")
#: Seconds of a call that costs less than handing it to a thread and back, or about as much.
SHORT = 0.002


@dataclass
class Outcome:
    """What became of one document: an answer, or the code and message of its failure."""

    answer: Answer | None = None
    code: str | None = None
    message: str | None = None
    latency_ms: float = 0.0
    asked: bool = True


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, as workers reach it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else uri)


@dataclass
class Stop:
    """A sign that one failure ends all calls: within a task at once, in other tasks by a file in a folder they share.

    Calls that are open when it goes up still end, and count.
    """

    uri: str | None = None
    up: bool = False

    def raise_(self) -> None:
        if not self.up and self.uri:
            system, path = opened(self.uri)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(b"")
        self.up = True

    def __call__(self) -> bool:
        if not self.up and self.uri:
            system, path = opened(self.uri)
            self.up = system.get_file_info(path).type != fs.FileType.NotFound
        return self.up


@dataclass
class Asker:
    """Asks a model for one document, with bounded retries of what is transient.

    make: which backend a (provider, model) needs; each thread has its own, made once.  failure: code and message of an exception.
    on_token: before the call that counts, a backend that can is asked for a stream, and what comes is handed on as it
    comes; a stream that breaks off, or a sink that fails, changes nothing.
    """

    make: Callable[[str | None, str | None], Callable]
    render: Callable[[str], tuple[str, str]]
    failure: Callable[[Exception], tuple[str, str]]
    attempts: int = 3
    wait: float = 0.0
    most_wait: float = 10.0
    on_token: Callable[[str], None] | None = None

    def __post_init__(self):
        self.own = threading.local()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "own"}

    def __setstate__(self, held: dict) -> None:
        self.__dict__.update(held)
        self.own = threading.local()

    def __call__(self, content: str, provider: str | None = None, model: str | None = None) -> Outcome:
        began = time.monotonic()
        answer, code, message = self._ask(content, provider, model)
        return Outcome(answer, code, message, 1000 * (time.monotonic() - began))

    def _stream(self, backend, content: str) -> None:
        if hasattr(backend, "stream"):
            try:
                for token in backend.stream(*self.render(content)):
                    self.on_token(token)
            except Exception:  # the call that counts tells what is wrong
                return

    def _ask(self, content: str, provider: str | None, model: str | None) -> tuple[Answer | None, str | None, str | None]:
        held = self.own.__dict__.setdefault("backends", {})
        for tried in range(1, self.attempts + 1):
            try:
                if (provider, model) not in held:
                    held[provider, model] = self.make(provider, model)()
                if self.on_token is not None and tried == 1:
                    self._stream(held[provider, model], content)
                got = held[provider, model].answer(*self.render(content))
                return (got if isinstance(got, Answer) else Answer(got)), None, None
            except TRANSIENT as e:
                if tried == self.attempts:
                    return None, *self.failure(e)
                time.sleep(min(max(self.wait, self.wait * 2 ** (tried - 1)), self.most_wait))
            except Exception as e:
                return None, *self.failure(e)
        return None, "CONFIG_ERROR", "no attempts"


def pooled(rows: Iterator, ask: Callable[..., Outcome], width: int = 1, stop: Stop | None = None) -> Iterator[tuple[object, Outcome]]:
    """(row, outcome) as calls end, with up to ``width`` of them open; after a stop what is left is not asked.

    ask(row) may return an outcome without a call.  Rows are taken from ``rows`` only as there is room for them.  After ``width``
    short calls in a row, and while no other is open, calls are made in this thread, until one is not short.
    """

    def one(row) -> Outcome:
        got = ask(row)
        if stop is not None and got.code is not None:
            stop.raise_()
        return got

    skipped = lambda: stop is not None and stop()
    if width <= 1:
        for row in rows:
            yield row, Outcome(None, *NOT_TRIED, asked=False) if skipped() else one(row)
        return
    pool, ended, under_way, short = ThreadPoolExecutor(width), SimpleQueue(), 0, 0

    def told(row) -> None:
        began = time.monotonic()
        try:
            ended.put((row, one(row), None, time.monotonic() - began))
        except BaseException as e:  # for the caller's thread
            ended.put((row, None, e, 0))

    def taken(most: float | None = None) -> tuple[object, Outcome] | None:
        """What ends next, or None after ``most`` seconds."""
        nonlocal short
        try:
            row, got, e, took = ended.get(timeout=most)
        except Empty:
            short = 0
            return None
        if e is not None:
            raise e
        short = short + 1 if took < SHORT else 0
        return row, got

    try:
        for row in rows:
            if skipped():
                yield row, Outcome(None, *NOT_TRIED, asked=False)
                continue
            if short >= width and not under_way:
                told(row)
            else:
                pool.submit(told, row)
            under_way += 1
            while under_way >= width or under_way and (short >= width or not ended.empty()):
                if (got := taken(None if under_way >= width else SHORT)) is None:
                    break
                under_way -= 1
                yield got
        for _ in range(under_way):
            yield taken()
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


# ---- the log ---------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    calls: int
    failures: int
    not_tried: int


def _keys_in(system: fs.FileSystem, folder: str, prefix: str) -> set[tuple]:
    """What earlier attempts of one task have logged; a line that was cut off is none."""
    keys = set()
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.is_file and info.base_name.startswith(prefix):
            with system.open_input_stream(info.path) as f:
                for line in f.read().split(b"\n"):
                    try:
                        held = json.loads(line)
                        keys.add(tuple(held[k] for k in KEYS))
                    except (ValueError, KeyError, TypeError):
                        continue
    return keys


class LogWriter(DataSourceWriter):
    """Asks for each row (document, content, provider, model, error_code, error_message) and logs the outcome.

    Lines reach the file system one by one.  A store that shows only closed files shows them by ``roll`` lines.  An attempt of
    a task first reads what earlier attempts of it, say on a lost executor, have logged, and doesn't ask for that again.
    """

    def __init__(self, path: str, run: str, ask: Asker, width: int, stop: Stop | None, roll: int):
        self.path, self.run, self.ask, self.width, self.stop, self.roll = path, run, ask, width, stop, roll

    def write(self, iterator: Iterator) -> Written:
        task = TaskContext.get()
        system, folder = opened(self.path)
        system.create_dir(folder, recursive=True)
        prefix = f"calls-{self.run}-{task.partitionId():06d}-"
        logged = _keys_in(system, folder, prefix)
        name = f"{folder}/{prefix}{task.attemptNumber():03d}-{uuid.uuid4().hex[:8]}"
        calls = failures = not_tried = lines = files = 0
        out = None
        left = (r for r in iterator if tuple(r[k] for k in KEYS) not in logged) if logged else iterator

        def ask(row) -> Outcome:
            if row["error_code"] is not None:
                return Outcome(None, row["error_code"], row["error_message"], asked=False)
            return self.ask(row["content"], row["provider"], row["model"])

        try:
            for row, got in pooled(left, ask, self.width, self.stop):
                if got.code == NOT_TRIED[0] and got.message == NOT_TRIED[1] and not got.asked:
                    not_tried += 1  # no record: a later run asks
                    continue
                calls, failures = calls + got.asked, failures + (got.code is not None)
                if out is None:
                    out, lines, files = system.open_output_stream(f"{name}-{files:04d}.jsonl", buffer_size=None), 0, files + 1
                told = {t: getattr(got.answer, t, None) for t in TOKENS}
                record = {k: row[k] for k in KEYS} | {"response": got.answer and got.answer.text, "error_code": got.code, "error_message": got.message, "latency_ms": got.latency_ms, **told, "ended": f"{time.time():.6f}"}
                out.write(json.dumps({k: v for k, v in record.items() if v is not None}).encode() + b"\n")
                out.flush()
                lines += 1
                if lines >= self.roll:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written(calls, failures, not_tried)

    def commit(self, messages: list) -> None:
        """Nothing is left to do: records stand since their calls ended."""

    def abort(self, messages: list) -> None:
        """Records stay, also those of a job that failed: their calls were made."""


def _sink(writer: LogWriter) -> type[DataSource]:
    class CallLog(DataSource):
        @classmethod
        def name(cls) -> str:
            return "cartulary_calls"

        def writer(self, schema, overwrite: bool) -> LogWriter:
            return writer

    return CallLog


def _logged(path: str) -> bool:
    """Whether a log has any record files."""
    system, folder = opened(path)
    return any(i.base_name.startswith("calls-") for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)))


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """All lines of a log that are whole."""
    return spark.read.schema(RECORD).option("pathGlobFilter", "calls-*.jsonl").json(path).where("document IS NOT NULL AND ended IS NOT NULL")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a log, one for each (document, provider, model): the first to end, should there be two.

    A line that a kill cut off isn't a record.
    """
    if not _logged(path):
        return spark.createDataFrame([], RECORD)
    raw = _raw(spark, path)
    rest = [c for c in raw.columns if c not in KEYS]
    return raw.groupBy(*KEYS).agg(F.min_by(F.struct(*rest), F.col("ended").cast("double")).alias("r")).select(*KEYS, "r.*")


def log(documents: DataFrame, models: DataFrame, path: str, ask: Asker, width: int = 1, stop: bool = False, partitions: int | None = None, again: bool = False, roll: int = 1000) -> DataFrame:
    """Ask every model for every document that the log in ``path`` has no record of, and return the log's records.

    documents: (document, content, error_code, error_message); models: few rows of (provider, model).  width: calls
    open at once in each of the ``partitions``.  stop: after the first failure no task begins another call.  again: also ask
    for what has failed before; the old records are rewritten without failures first.
    """
    spark = documents.sparkSession
    if again:
        _drop_failures(spark, read(spark, path), path)
    asked = [F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m in models.select("provider", "model").distinct().collect()]
    every = F.array(*asked) if asked else F.array().cast("array<struct<provider:string,model:string>>")
    todo = documents.select("document", "content", "error_code", "error_message")
    if _logged(path):
        # a document meets what it has been asked once, and its text is dealt once, however many models there are
        had = _raw(spark, path).groupBy(F.col("document").alias("_document")).agg(F.collect_set(F.struct("provider", "model")).alias("_had"))
        todo = todo.join(had, F.col("document") == F.col("_document"), "left")
        every = F.array_except(every, F.coalesce("_had", F.array().cast("array<struct<provider:string,model:string>>")))
    todo = todo.select("document", "content", "error_code", "error_message", F.explode(every).alias("_to")).select("document", "content", "_to.provider", "_to.model", "error_code", "error_message")
    todo = todo.repartition(partitions) if partitions else todo
    run = uuid.uuid4().hex[:12]
    writer = LogWriter(path, run, ask, width, Stop(f"{path}/_stopped-{run}") if stop else None, roll)
    spark.dataSource.register(_sink(writer))
    todo.write.format("cartulary_calls").mode("append").save()
    return read(spark, path)


def _drop_failures(spark: SparkSession, done: DataFrame, path: str) -> None:
    """Replace the log by its successes: they are written beside it under a new name before the old files go."""
    system, folder = opened(path)
    old = [i.path for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.is_file and i.base_name.startswith("calls-")]
    if not old:
        return
    kept, name = f"{path}/_kept-{uuid.uuid4().hex[:8]}", f"calls-kept-{uuid.uuid4().hex[:8]}"
    done.where("error_code IS NULL").write.json(kept)
    _, inside = opened(kept)
    for n, info in enumerate(i for i in system.get_file_info(fs.FileSelector(inside)) if i.base_name.startswith("part-")):
        system.move(info.path, f"{folder}/{name}-{n:06d}.jsonl")
    for f in old:
        system.delete_file(f)
    system.delete_dir(inside)


__all__ = ["KEYS", "RECORD", "TOKENS", "Asker", "LogWriter", "Outcome", "Stop", "Written", "log", "opened", "pooled", "read"]
