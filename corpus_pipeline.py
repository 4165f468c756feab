"""A corpus pipeline: reject toxic documents, keep one of each group of near duplicates, redact personal data, put the
sources in their mixing order, encode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; the runner writes it as Parquet and reads it back as the
next stage's docs.  All but the last return the columns of documents, and n_chars follows the text.  Null and empty texts,
repeated rows, extra columns and empty tables are treated as the operators say; such rows are kept by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import byte_bpe, minhash, mixing, pii, toxicity
from cartulary.llm.common import discard, stored_at
from cartulary.llm.queries import vocabulary

TOXIC = 0.7
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model learns from labelled documents of this stage's input."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id, null ids last; rows alike in id and text are one.

    Classes are those of (id, text), so unlike texts of one id are documents of their own.
    """
    rows = docs.select(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("_row"), *COLUMNS)
    classes = minhash.classes(rows.select("_row", "doc_id", "text"), "_row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("least")
    keys = classes.groupBy("class_id").agg(least).select("least._row")
    # rows are grouped by their text too, so unlike rows of one hash are not taken for one
    first = F.min(F.struct("lang", "source", "n_chars")).alias("first")
    kept = rows.join(keys, "_row", "left_semi").groupBy("_row", "doc_id", "text").agg(first)
    return kept.select("doc_id", "text", "first.*").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with <KIND> in place of personal data."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, written in mixing order: files and their rows follow ``place``."""
    return mixing.mix(docs.select(*COLUMNS)).orderBy("place").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, as little-endian 32-bit integers, with their number and digests of ids and decoded bytes.

    Spark reads files in an order of its own, so ``place`` follows from the documents again; rows are in its order.
    """
    path, pattern = vocabulary()
    placed = mixing.mix(docs.select("doc_id", "source", "text")).select("place", "doc_id", "source", "text").orderBy("place")
    coded = byte_bpe.encode(placed, path, pattern, decoded=True)
    return coded.select("place", "doc_id", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_copies), ("personal_data", redact_personal_data), ("mixing", mix_sources), ("byte_bpe", encode)]
#: No SQL: a trained model, hash draws and token merges are beyond it; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is deleted once its successor's stands in the shared folder, the last one stays to be read."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored_at(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
