"""The shared folder, and results that are worked out once."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; below the warehouse where none is named and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def held(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder: what is read from it calls no model and parses no file again."""
    path = f"{shared_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file by the file system that Spark reads it with."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def stands(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, asked of the file system that Spark reads it with."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def spooled(spark: SparkSession, rows: Iterable[dict], schema: str, size: int = 1_000_000) -> DataFrame:
    """Rows that only the driver can make, one after the other, as a DataFrame: they go to the shared folder in pieces and are never all in memory."""
    path = f"{shared_folder(spark)}/spooled-{uuid.uuid4().hex}.jsonl"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out, held_lines, n = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True), [], 0
    try:
        for row in rows:
            held_lines.append(json.dumps(row).encode() + b"\n")
            n += len(held_lines[-1])
            if n >= size:
                out.write(bytearray(b"".join(held_lines)))
                held_lines, n = [], 0
        out.write(bytearray(b"".join(held_lines)))
    finally:
        out.close()
    return spark.read.schema(schema).json(path)
