"""Predictions against ground truth: comparisons, accuracies, confusion, side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import text

AXES = ("domain", "category", "doctype")
OPTIONAL = ("vendor", "date")


def compared(predictions: DataFrame, truth: DataFrame, key: str = "filename") -> DataFrame:
    """Inner join with p_ and a_ columns and <field>_ok: without case but for dates; null where the truth has no optional value."""
    p = predictions.select(key, *[F.col(c).alias(f"p_{c}") for c in (*AXES, *OPTIONAL)])
    a = truth.select(key, *[F.col(c).alias(f"a_{c}") for c in (*AXES, *OPTIONAL)])
    same = {f"{c}_ok": F.coalesce(F.lower(f"p_{c}") == F.lower(f"a_{c}"), F.lit(False)) for c in AXES}
    same["vendor_ok"] = F.when(F.col("a_vendor").isNotNull(), F.coalesce(F.lower("p_vendor") == F.lower("a_vendor"), F.lit(False)))
    same["date_ok"] = F.when(F.col("a_date").isNotNull(), F.coalesce(F.col("p_date") == F.col("a_date"), F.lit(False)))
    return p.join(a, key).withColumns(same)


def accuracy(rows: DataFrame) -> DataFrame:
    """One row: total, the three axes' accuracy (0 of no rows), the optional fields' (null without truth), and joint ones."""
    share = lambda c: F.avg(c.cast("double"))
    axes = [F.coalesce(share(F.col(f"{c}_ok")), F.lit(0.0)).alias(f"{c}_accuracy") for c in AXES]
    rest = [share(F.col(f"{c}_ok")).alias(f"{c}_accuracy") for c in OPTIONAL]
    path = F.coalesce(share(F.col("domain_ok") & F.col("category_ok") & F.col("doctype_ok")), F.lit(0.0)).alias("path_joint")
    name = share(F.col("vendor_ok") & F.col("date_ok")).alias("filename_joint")
    return rows.agg(F.count("*").alias("total"), *axes, *rest, path, name)


def first_mistakes(rows: DataFrame, most: int = 5, axis: str = "domain") -> tuple[list[str], int]:
    """Lines of the first wrong rows by file name, and how many there are beyond them."""
    wrong = rows.where(~F.col(f"{axis}_ok"))
    shown = wrong.orderBy("filename").select("filename", f"a_{axis}", f"p_{axis}").limit(most).collect()
    return [f"{r[0]}: {r[1]} -> {r[2]}" for r in shown], max(wrong.count() - most, 0)


def text_summary(rows: DataFrame, provider: str, model: str) -> str:
    """The evaluation as text: accuracies, then the first mistakes of the domain."""
    score = accuracy(rows).first()
    out = [f"Evaluation Results ({provider}/{model})", "=" * 50, f"Total documents: {score['total']}"]
    out += [f"{c.capitalize() + ' accuracy:':<18} {100 * score[f'{c}_accuracy']:5.1f}%" for c in (*AXES, *OPTIONAL) if score[f"{c}_accuracy"] is not None]
    lines, more = first_mistakes(rows)
    if lines:
        out += ["", f"Domain misclassifications ({len(lines) + more}):", *[f"  {x}" for x in lines], *([f"  ... and {more} more"] if more else [])]
    return "\n".join(out)


def stub_issues(truth: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    """(filename, issue): entries with an empty required field, entries without a file, files without an entry."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    blank = F.array_compact(F.array(*[F.when(empty(F.col(c)), F.lit(c)) for c in AXES]))
    stubs = truth.withColumn("_b", blank).where(F.size("_b") > 0).select(key, F.concat(F.lit("empty: "), F.array_join("_b", ", ")).alias("issue"))
    lost = unmatched(truth, files, key).select(key, F.lit("no file").alias("issue"))
    return stubs.unionByName(lost).unionByName(unmatched(files, truth, key).select(key, F.lit("no entry").alias("issue")))


def confusion(rows: DataFrame) -> DataFrame:
    """(axis, actual, predicted, n), all in lower case."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("axis"), F.lower(f"a_{c}").alias("actual"), F.lower(f"p_{c}").alias("predicted")) for c in AXES])).alias("x")).select("x.*")
    return long.groupBy("axis", "actual", "predicted").agg(F.count("*").alias("n"))


def unmatched(truth: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    """Ground truth without a file."""
    return truth.join(files, key, "left_anti")


def side_by_side(one: DataFrame, other: DataFrame, key: str = "filename") -> DataFrame:
    """Two comparisons of one ground truth: <axis>_a, <axis>_b; null where a side lacks the file."""
    pick = lambda df, s: df.select(key, *[F.col(f"{c}_ok").alias(f"{c}_{s}") for c in AXES])
    return pick(one, "a").join(pick(other, "b"), key, "full_outer")


def strict_matches(expected: dict, predicted: dict):
    """A map of the experiment's comparisons: exact but for vendor (its tokens) and subject (its tokens are all there)."""
    exact = ("domain", "category", "doctype", "date")
    pairs = [x for c in exact for x in (F.lit(c), F.coalesce(expected[c] == predicted[c], F.lit(False)))]
    vendor = F.coalesce(text.vendor_tokens(expected["vendor"]) == text.vendor_tokens(predicted["vendor"]), F.lit(False))
    subject = F.coalesce(text.subject_covers(expected["subject"], predicted["subject"]), F.lit(False))
    return F.create_map(*pairs, F.lit("vendor"), vendor, F.lit("subject"), subject)
