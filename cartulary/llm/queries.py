"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import suffix_dedup

    left = suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import embedding_dedup

    return embedding_dedup.classes(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")).select("vec_id", "n_links", "component_id", "kept")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import byte_bpe

    path, pattern = vocabulary()
    coded = byte_bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path, pattern, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import quality_rules

    judged = quality_rules.judge(table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import minhash

    return minhash.classes(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "kept")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import pii

    found = pii.find(table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))))
    counts = [F.expr(f"CAST(size(filter(base_spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base_spans")), 256).alias("base_sha256"), pii.joined(F.concat("base_spans", "added_spans")).alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import mixing

    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "block", "slot", "release", "due", "place")


def _scored(spark: SparkSession, sf_dir: str, operator, limit: float) -> DataFrame:
    from cartulary.llm import labelled

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = operator.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(labelled.fold() == 1, F.lit(False))
    return operator.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import quality_classifier

    return _scored(spark, sf_dir, quality_classifier, 0.5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import toxicity

    return _scored(spark, sf_dir, toxicity, 0.7)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def damaged(df: DataFrame) -> DataFrame:
    """Turns with one fault in four at most: dropped, emptied, without sentence ends, repeated, or the user's; nulls are one space."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = (F.crc32(F.concat_ws(":", filled["conv_id"], filled["turn"]).cast("binary")) % 20).alias("fault")
    each = df.select("conv_id", "turn", filled["role"].alias("role"), filled["text"].alias("text"), fault).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("time")
    return each.select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("time")


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import turns

    source = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = turns.report(turns.parts(damaged(source)))
    ids = source.select("conv_id").distinct()
    met = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import line_dedup

    left = line_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cartulary.llm import spelling

    words = spelling.vocabulary(table(spark, sf_dir, "documents", "doc_id", "text"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = (op1_suffix_dedup, op2_embedding_dedup, op3_byte_bpe, op4_quality_rules, op5_mixing, op6_quality_classifier, op7_toxicity, op8_minhash, op9_pii, op10_html_text, op11_turns, op12_line_dedup, op13_spelling)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from cartulary.llm import oracles

    return {"op4_quality_rules": oracles.quality_rules_sql(), "op11_turns": oracles.TURNS_SQL, "op12_line_dedup": oracles.LINE_DEDUP_SQL}
