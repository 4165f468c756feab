"""Classification of a landing folder as a stream, batch by batch, each document once.

What has come already is remembered until the watermark passes it.  A batch that is replayed after a failure finds its calls in
the log and its rows in place: it asks nothing again and adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary import calls
from cartulary.classify import Keywords, asker, classify, finished, prepared
from cartulary.storage import discard, put, shared_folder, stands
from cartulary.vocabulary import get

SCHEMA = "doc_id long, text string"


def arriving(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A stream of documents as Parquet files of a folder arrive."""
    head, _, tail = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(path if not tail.endswith(".parquet") else f"{head}/{tail}*")


def as_documents(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"), none.alias("error_code"), none.alias("error_message"))


def unique_within(df: DataFrame, time: str, key: str = "path", delay: str = "1 hour") -> DataFrame:
    """Documents whose path has not come within ``delay``; what is remembered ends with the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def classified(stream: DataFrame, base: str, make, model: tuple[str, str] = ("local", "stand-in"), on_batch=None, width: int = 1, **options):
    """Start to classify a stream of (path, content, error_code, error_message) into ``base``; returns the writer, to be triggered.

    make(provider, model): what makes a backend.  on_batch(results, number) is called once a batch's results stand, with the table
    they were written to; should the driver be lost within it, it is called again with the same number, and otherwise never twice.
    options go to the asker (template, attempts, ...) and to ``finished`` (mode, naming, vocabulary).
    """
    shape = {k: options.pop(k) for k in ("mode", "naming", "vocabulary") if k in options}
    v = shape.get("vocabulary") or get()
    ask = asker(make, menu=v.menu(), **options)

    def sink(batch: DataFrame, number: int) -> None:
        # a batch's own session plans without adaptive execution: every small step would be as many tasks as the stream's state has parts
        spark, place, texts = stream.sparkSession, f"{base}/out/batch={number}", f"{base}/texts/{number}"
        if stands(spark, f"{base}/done/{number}"):
            return
        ready = prepared(batch)
        ready.write.mode("overwrite").parquet(f"{texts}/all")
        ready = spark.read.schema(ready.schema).parquet(f"{texts}/all")
        # within a batch the first of equal paths counts, as in the stream; texts are dealt anew only where there are such
        n, twice = ready.groupBy("path").count().agg(F.count("*"), F.coalesce(F.max("count"), F.lit(0))).first()
        if twice > 1:
            ready.dropDuplicates(["path"]).write.mode("overwrite").parquet(f"{texts}/first")
            ready = spark.read.schema(ready.schema).parquet(f"{texts}/first")
        if not n:  # a batch that only moves the watermark
            discard(spark, texts)
            return
        models = spark.createDataFrame([model], "provider string, model string")
        logged = calls.log(ready.withColumnRenamed("path", "document"), models, f"{base}/calls", ask, width=width)
        mine = logged.join(ready.select(F.col("path").alias("document"), "loader_latency_ms", "loader_backend"), "document").withColumnRenamed("document", "path")
        finished(mine, **shape).write.mode("overwrite").parquet(place)
        if on_batch is not None:
            on_batch(spark.read.parquet(place), number)
        put(spark, f"{base}/done/{number}", "")
        discard(spark, texts)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state")


def results(spark: SparkSession, base: str) -> DataFrame:
    """What a stream has classified so far, of batches that are done."""
    return spark.read.parquet(f"{base}/out").drop("batch")


def drained(spark: SparkSession, path: str) -> DataFrame:
    """Classify all that lies in the folder, batch by batch, into a table in the shared folder; the result is that table."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        classify(as_documents(batch), Keywords).select("original", "suggested_path", "domain", "category", "doctype", "error_code").write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    stream = arriving(spark, path).writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")
