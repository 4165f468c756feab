"""Canonical terms of raw classifications: a lookup on each axis, categories within their canonical domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import text
from cartulary.vocabulary import Vocabulary, get

OTHER = "other"
AXES = ("domain", "category", "doctype")


def _lookup(df: DataFrame, dim: DataFrame, on: dict[str, Column], value: str, name: str) -> DataFrame:
    """Left join with a vocabulary table, which is some hundred rows and so broadcast."""
    keyed = dim.select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col(value).alias(name))
    keys = df.withColumns({f"_k_{c}": column for c, column in on.items()})
    return keys.join(F.broadcast(keyed), list(keyed.columns[:-1]), "left").drop(*keyed.columns[:-1])


def canonicalise(df: DataFrame, vocabulary: Vocabulary | None = None, mode: str = "fallback", prefix: str = "canon_") -> DataFrame:
    """Add canon_domain, canon_category, canon_doctype.

    mode: ``fallback`` puts "other" where there is no canonical term; ``null`` leaves null; ``strict`` leaves null and adds
    error_code and error_message of the first axis that fails, in the order domain, category, doctype.
    """
    if mode not in ("fallback", "null", "strict"):
        raise ValueError(f"unknown mode {mode!r}")
    dims = (vocabulary or get()).tables(df.sparkSession)
    d, c, t = (prefix + a for a in AXES)
    out = _lookup(df, dims["domain"], {"raw": text.normalise(F.col("domain"))}, "canonical", d)
    out = _lookup(out, dims["category"], {"domain": F.col(d), "raw": text.normalise(F.col("category"))}, "canonical", c)
    out = _lookup(out, dims["doctype"], {"raw": text.normalise(F.col("doctype"))}, "canonical", t)
    if mode == "fallback":
        return out.withColumns({x: F.coalesce(F.col(x), F.lit(OTHER)) for x in (d, c, t)})
    if mode == "strict":
        failed = F.when(F.col(d).isNull(), "domain").when(F.col(c).isNull(), "category").when(F.col(t).isNull(), "doctype")
        raw = F.when(F.col(d).isNull(), F.col("domain")).when(F.col(c).isNull(), F.col("category")).otherwise(F.col("doctype"))
        return out.withColumns({"error_code": F.when(failed.isNotNull(), "TAXONOMY_VALIDATION_FAILED"), "error_message": F.concat(F.lit("unknown "), failed, F.lit(": "), F.coalesce(raw, F.lit("null")))})
    return out


def with_singular(df: DataFrame, doctype: str = "canon_doctype", vocabulary: Vocabulary | None = None) -> DataFrame:
    """Add ``singular`` of the doctype; a doctype that has none stands for itself."""
    dim = (vocabulary or get()).tables(df.sparkSession)["singular"]
    return _lookup(df, dim, {"canonical": F.col(doctype)}, "one", "singular").withColumn("singular", F.coalesce("singular", doctype))
