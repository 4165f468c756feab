"""What a corpus of raw classifications holds: term frequencies, drift, tuples, vendors and years."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import text
from cartulary.operators.canonicalise import AXES, canonicalise
from cartulary.vocabulary import Vocabulary


def normalised(df: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """raw_<axis> (normalised, empty: null) and canon_<axis> (null where unknown) of every row, and ``complete``."""
    out = canonicalise(df, vocabulary, "null").withColumns({f"raw_{a}": text.harvest_normalise(F.col(a)) for a in AXES})
    return out.withColumn("complete", F.col("raw_domain").isNotNull() & F.col("raw_category").isNotNull() & F.col("raw_doctype").isNotNull())


def _long(rows: DataFrame) -> DataFrame:
    each = [F.struct(F.lit(a).alias("field"), F.col(f"raw_{a}").alias("raw"), F.col(f"canon_{a}").alias("canonical"), (F.coalesce("canon_domain", "raw_domain") if a == "category" else F.lit(None).cast("string")).alias("domain")) for a in AXES]
    return rows.where("complete").select(F.explode(F.array(*each)).alias("x")).select("x.*")


def term_frequency(rows: DataFrame) -> DataFrame:
    """(kind, axis, term, n): raw terms, and canonical ones where there is one."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("term")) for k, c in (("raw", "raw"), ("canonical", "canonical"))])).alias("t")
    return _long(rows).select(F.col("field").alias("axis"), kinds).select("axis", "t.*").where("term IS NOT NULL").groupBy("kind", "axis", "term").agg(F.count("*").alias("n"))


def drift(rows: DataFrame) -> DataFrame:
    """(field, raw, canonical, domain, n) of terms that are not their own canonical one; unknown terms drift to null."""
    return _long(rows).where(~F.col("raw").eqNullSafe(F.col("canonical"))).groupBy("field", "raw", "canonical", "domain").agg(F.count("*").alias("n"))


def tuples(rows: DataFrame) -> DataFrame:
    """(kind, domain, category, doctype, n), raw and canonical, the latter with nulls."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), *[F.col(f"{p}_{a}").alias(a) for a in AXES]) for k, p in (("raw", "raw"), ("canonical", "canon"))])).alias("t")
    return rows.where("complete").select(kinds).select("t.*").groupBy("kind", *AXES).agg(F.count("*").alias("n"))


def vendors(rows: DataFrame) -> DataFrame:
    return rows.select(text.vendor_slug(F.col("vendor")).alias("vendor")).where("vendor IS NOT NULL").groupBy("vendor").agg(F.count("*").alias("n"))


def years(rows: DataFrame) -> DataFrame:
    return rows.select(text.year_bucket(F.col("date")).alias("year")).where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("n"))


def counters(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("complete").alias("processed"), F.count_if(~F.col("complete")).alias("errors"))


def discovered(df: DataFrame) -> DataFrame:
    """(kind, domain, terms): distinct terms, sorted and joined; categories within their domain."""
    norm = df.select(*[text.discovery_normalise(F.col(a)).alias(a) for a in AXES])
    none = F.lit(None).cast("string")
    each = F.explode(F.array(F.struct(F.lit("domain").alias("kind"), none.alias("domain"), F.col("domain").alias("term")), F.struct(F.lit("category").alias("kind"), F.col("domain").alias("domain"), F.col("category").alias("term")), F.struct(F.lit("doctype").alias("kind"), none.alias("domain"), F.col("doctype").alias("term")))).alias("x")
    return norm.select(each).select("x.*").where("term IS NOT NULL").distinct().groupBy("kind", "domain").agg(F.array_join(F.sort_array(F.collect_list("term")), ",").alias("terms"))


def report(rows: DataFrame, model: str, taxonomy: str, stamp: str) -> dict:
    """The harvest as one object; only counted terms, as many as the vocabulary and its drift, come to the driver."""
    plural = {"domain": "domains", "category": "categories", "doctype": "doctypes"}
    frequency: dict = {"raw": {p: {} for p in plural.values()}, "canonical": {p: {} for p in plural.values()}}
    for r in term_frequency(rows).orderBy(F.desc("n"), "term").collect():
        frequency[r["kind"]][plural[r["axis"]]][r["term"]] = r["n"]
    each = lambda df, *order: [r.asDict() for r in df.withColumnRenamed("n", "count").orderBy(F.desc("count"), *order).collect()]
    pairs = {kind: each(tuples(rows).where(F.col("kind") == kind).drop("kind"), *AXES) for kind in ("raw", "canonical")}
    count = counters(rows).first()
    one = lambda df, c: {r[c]: r["n"] for r in df.orderBy(F.desc("n"), c).collect()}
    return {
        "metadata": {"corpus_size": count["processed"] + count["errors"], "processed": count["processed"], "errors": count["errors"], "model": model, "taxonomy": taxonomy, "timestamp": stamp},
        "raw_term_frequency": frequency["raw"],
        "canonical_term_frequency": frequency["canonical"],
        "drift": each(drift(rows), "field", "raw", "domain"),
        "raw_tuples": pairs["raw"],
        "canonical_tuples": pairs["canonical"],
        "vendor_frequency": one(vendors(rows), "vendor"),
        "date_frequency": one(years(rows), "year"),
    }


def vocabulary_text(found: DataFrame, files: int, errors: int, form: str = "python") -> str:
    """``discovered`` terms as Python source or JSON."""
    terms: dict = {"domain": [], "category": {}, "doctype": []}
    for r in found.collect():
        listed = r["terms"].split(",")
        if r["kind"] == "category":
            terms["category"][r["domain"] or ""] = listed
        else:
            terms[r["kind"]] = listed
    categories = dict(sorted(terms["category"].items()))
    if form == "json":
        return json.dumps({"metadata": {"file_count": files, "error_count": errors}, "domains": terms["domain"], "categories": categories, "doctypes": terms["doctype"]}, indent=2)
    if form != "python":
        raise ValueError(f"unknown format {form!r}")
    quoted = lambda xs: "{" + ", ".join(json.dumps(x, ensure_ascii=False) for x in xs) + "}" if xs else "set()"
    body = "".join(f"    {json.dumps(d, ensure_ascii=False)}: {quoted(c)},\n" for d, c in categories.items())
    return f"# Discovered from {files} documents ({errors} errors)\nDISCOVERED_DOMAINS: set[str] = {quoted(terms['domain'])}\nDISCOVERED_CATEGORIES: dict[str, set[str]] = {{\n{body}}}\nDISCOVERED_DOCTYPES: set[str] = {quoted(terms['doctype'])}\n"


def verdicts(joined: DataFrame, least: int = 5, *, moved: int = 8) -> DataFrame:
    """``delta`` with ``verdict``: new (reaches ``least`` and did not before), gone (the reverse), moved (by ``moved``), or steady."""
    was, now = F.col("base") >= least, F.col("new") >= least
    return joined.withColumn("verdict", F.when(now & ~was, "new").when(was & ~now, "gone").when(F.abs("delta") >= moved, "moved").otherwise("steady"))


def within(base: DataFrame, new: DataFrame, documents: int = 10, errors: int = 25) -> DataFrame:
    """Counters of two harvests -> one row: whether as many documents (give or take) were processed, with few errors."""
    a, b = base.select(F.col("processed").alias("base_processed")), new.select("processed", "errors")
    one = F.lit(1).alias("_one")
    both = a.withColumn("_one", one).join(b.withColumn("_one", one), "_one").drop("_one")
    return both.withColumn("accepted", (F.abs(F.col("processed") - F.col("base_processed")) <= documents) & (F.col("errors") <= errors))


def delta(base: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Two frequencies side by side and their difference; a term that one lacks counts as 0 there."""
    a, b = base.select(*keys, F.col("n").alias("base")), new.select(*keys, F.col("n").alias("new"))
    joined = a.join(b, list(keys), "full_outer").fillna(0, ["base", "new"])
    return joined.withColumn("delta", F.col("new") - F.col("base"))


def sample(files: DataFrame, n: int, seed: int, path: str = "path") -> DataFrame:
    """The first n by a seeded hash of the path; all if n is not between 0 and their number."""
    return files if n <= 0 else files.orderBy(F.xxhash64(F.col(path), F.lit(seed)), path).limit(n)
