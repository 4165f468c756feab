"""Run history: what folder names tell, merging runs, series by date."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ("domain_accuracy", "category_accuracy", "doctype_accuracy", "vendor_accuracy", "date_accuracy")


#: What of a run may be shown; anything else in its file, such as single documents, is dropped.
AGGREGATES = (*METRICS, "model", "provider", "total", "errors", "commit_hash", "commit", "runtime_seconds", "wallclock_s")
VERSION = 1
OPEN, CLOSE = '<script id="data" type="application/json">', "</script>"
#: Columns of runs read from files: numbers may be missing.
RUN = ", ".join([f"{m} double" for m in METRICS] + ["model string", "provider string", "total long", "errors long", "commit_hash string", "commit string", "runtime_seconds double", "wallclock_s double"])


def aggregates(df: DataFrame) -> DataFrame:
    """Only those columns of a run that may be shown, and where it is from."""
    return df.select(*[c for c in df.columns if c in (*AGGREGATES, "run_id", "date", "corpus", "loader", "loader_variant", "folder", "file")])


def described(runs: DataFrame) -> DataFrame:
    """Runs with folder and file names -> run_id (the file's own, if it has one), date, corpus, loader and variant as the names tell them, and a runtime.

    The runtime is the file's own, or else ``log_seconds``, if there is such a column.
    """
    own = [F.col("run_id")] if "run_id" in runs.columns else []
    named = runs.withColumns({"run_id": F.coalesce(*own, F.concat_ws("/", "folder", "file")), "date": date_of(F.col("folder")), "corpus": corpus_of(F.col("folder")), "loader": loader_of(F.col("file")), "loader_variant": variant_of(F.col("folder"))})
    log = F.col("log_seconds") if "log_seconds" in runs.columns else F.lit(None).cast("double")
    return named.withColumn("runtime_seconds", F.coalesce("runtime_seconds", "wallclock_s", log)).drop("log_seconds")


def of_corpus(runs: DataFrame, synthetic: bool = True, real: bool = True) -> DataFrame:
    """The runs of the corpora that are shown."""
    return runs.where(F.col("corpus").isin([c for c, on in (("synthetic", synthetic), ("real-world", real)) if on]))


def existing(text: str | None) -> list[dict]:
    """The runs of a dashboard's JSON; none where there is no text."""
    return json.loads(text).get("runs", []) if text and text.strip() else []


def document(runs: DataFrame, stamp: str) -> str:
    """The dashboard's JSON: runs by date, then run_id.  Runs are evaluations, so they are few."""
    rows = [{k: v for k, v in r.asDict().items() if v is not None} for r in runs.orderBy(F.coalesce("date", F.lit("0000-00-00")), "run_id").collect()]
    return json.dumps({"schema_version": VERSION, "generated_at": stamp, "runs": rows}, indent=2) + "\n"


def spliced(page: str, data: str) -> str:
    """A page with ``data`` in its data block; without the block's marks that is an error."""
    head, mark, rest = page.partition(OPEN)
    end = rest.find(CLOSE)
    if not mark or end < 0:
        raise ValueError(f"the page has no block {OPEN} ... {CLOSE}")
    # a closing mark inside the data would end the block
    return head + mark + "\n" + data.replace("</", "<\\/") + rest[end:]


def loader_of(filename):
    last = F.element_at(F.split(F.regexp_replace(F.element_at(F.split(filename, "/"), -1), r"(?<=.)\.[^.]+$", ""), "_"), -1)
    return F.when(last.isin("docling", "unstructured"), last).otherwise("unknown")


def corpus_of(folder):
    return F.when(F.contains(folder, F.lit("real-world")) | F.contains(folder, F.lit("post-audit")) | F.contains(folder, F.lit("realworld")), "real-world").otherwise("synthetic")


def date_of(folder):
    dashed, plain = F.regexp_extract(folder, r"\d{4}-\d{2}-\d{2}", 0), F.regexp_extract(folder, r"\d{8}", 0)
    return F.when(dashed != "", dashed).when(plain != "", F.concat_ws("-", F.substring(plain, 1, 4), F.substring(plain, 5, 2), F.substring(plain, 7, 2))).otherwise("unknown")


def variant_of(folder):
    has = lambda s: F.contains(folder, F.lit(s))
    return F.when(has("picture-ocr"), "picture-region-ocr").when(has("structured") & has("real-world"), "structured-regions").when(has("post-audit"), "full-page-ocr")


def usable(runs: DataFrame) -> DataFrame:
    """Runs with a metric and a date."""
    return runs.where(F.coalesce(*METRICS).isNotNull()).where("date IS NOT NULL AND date NOT IN ('', 'unknown')")


def merged(held: DataFrame, found: DataFrame) -> DataFrame:
    """Usable held runs, and usable found ones whose run_id is new."""
    return usable(held).unionByName(usable(found).join(held.select("run_id"), "run_id", "left_anti"), allowMissingColumns=True)


def series(runs: DataFrame) -> DataFrame:
    model = F.when(F.length("model") > 22, F.concat(F.substring("model", 1, 20), F.lit("…"))).otherwise(F.col("model"))
    variant = F.when(F.coalesce("loader_variant", F.lit("")) != "", F.concat(F.lit(" ("), F.col("loader_variant"), F.lit(")"))).otherwise("")
    return runs.withColumn("series", F.concat(model, F.lit(" + "), F.col("loader"), variant))


def percent(value):
    """One decimal, half up, as the page shows it."""
    return F.floor(value * 1000 + 0.5) / 10


def pivot(runs: DataFrame, metric: str, dates: list[str], order: str = "run_order") -> DataFrame:
    """A row for each series and a column for each date: the metric of that date's last run."""
    return series(runs).groupBy("series").pivot("date", dates).agg(percent(F.max_by(metric, order)))


def runtime(seconds, size):
    """Seconds a document as text: 20.5s, or 1m 5s from a minute on."""
    each = seconds / size
    return F.when(each >= 60, F.concat(F.floor(each / 60).cast("string"), F.lit("m "), F.floor(each % 60 + 0.5).cast("string"), F.lit("s"))).otherwise(F.concat(F.round(each, 1).cast("string"), F.lit("s")))


def seconds_between(first, last):
    """Between two time stamps of a log, with the dates told apart; null if not positive."""
    n = F.unix_timestamp(last) - F.unix_timestamp(first)
    return F.when(n > 0, n)
