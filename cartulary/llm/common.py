"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every operator here: runs of anything but the six ASCII white-space characters.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; one is set only where none is named (tests, local runs)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    spark.sparkContext.setCheckpointDir(named)
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Like cut, but as compressed Parquet in the shared folder, for wide rows; and where that is."""
    path = f"{checkpoint_root(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Memo(dict):
    """What a Python worker keeps from one batch to the next, for one owner: ``LIMIT`` bytes at most."""

    LIMIT = 32_000_000
    held: Memo | None = None

    def __init__(self, owner: tuple):
        super().__init__()
        self.owner, self.left, self.model = owner, self.LIMIT, None

    def learn(self, new: dict) -> None:
        """Add entries as long as there is room."""
        for k, v in new.items():
            if self.left <= 0:
                return
            self.left -= sys.getsizeof(k) + sys.getsizeof(v) + 100
            self[k] = v


def memo(*owner) -> Memo:
    """The worker's only memo; what another owner left in it is dropped first."""
    if Memo.held is None or Memo.held.owner != owner:
        Memo.held = None
        gc.collect()
        Memo.held = Memo(owner)
    return Memo.held


def give_back() -> None:
    """Return freed memory to the system, which the executor's other workers and its JVM share."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Keys that may be called hot: each has more than one in HOT of all rows, so there are fewer than HOT of them.
HOT = 1000


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], total: int, many: str = "many") -> DataFrame:
    """Inner join of ``rows`` with one row a key of ``table``, whose column ``many`` says how many rows of ``rows`` the key has.

    total: of all rows.  Hot keys' rows of ``table``, fewer than HOT, are broadcast, so that no key's rows meet in one task;
    of the others none has more than one in HOT of all rows.  ``rows`` is read twice.
    """
    limit = total // HOT + 1
    hot = F.broadcast(table.where(F.col(many) > limit))
    cool = rows.join(F.broadcast(table.where(F.col(many) > limit).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(cool.join(table.where(F.col(many) <= limit), keys))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores after it until no column of ``df`` bears it (Spark takes letters of either case for one)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def slices(batch: pa.RecordBatch, column: int | str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that a text column holds about ``limit`` bytes at a time (one row at least)."""
    sizes = batch.column(column).to_pandas().map(lambda x: len(x) if x is not None else 0).to_numpy()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def per_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: int | str, limit: int = 2_000_000):
    """A mapInArrow function that hands ``fn`` bounded slices and drops nothing.

    A worker that served another operator's module before forgets what that one kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if Memo.held is not None and Memo.held.owner[0] != fn.__module__:
            memo(fn.__module__)
        for batch in batches:
            for part in slices(batch, column, limit):
                yield fn(part)
        give_back()

    return run


def text_or_empty(df: DataFrame, text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))
