"""Documents times models: run records, their accuracies, latencies and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("domain", "category", "doctype", "vendor", "date", "subject")
BROADCAST_ROWS = 10_000
#: Rows of any one list in a report.
REPORTED = 100_000


def matrix(documents: DataFrame, models: list[tuple[str, str]]) -> DataFrame:
    """Every document with every model; the models are an argument's few rows."""
    if len(models) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} models")
    rows = documents.sparkSession.createDataFrame(models, "provider string, model string")
    return documents.crossJoin(F.broadcast(rows))


def run(documents: DataFrame, models: list[tuple[str, str]], make, name: str, stamp: str, expected: DataFrame | None = None, log: str | None = None, again: bool = False, **options) -> DataFrame:
    """Run records of every document with every model: one call each.

    documents: as loaded, parsed once and held; make(provider, model): what makes a backend; expected: (document,
    expected map).  Models are rows, so the plan is the same for one and for many.  log: a folder in which every call's outcome
    is kept as it ends; (document, provider, model) that are there are not asked again.  Without one, a folder of its own in the shared
    folder.  again: failures of the log are asked again.  options go to ``calls.log`` (partitions, width, stop), to the asker and to
    ``finished``.  What fails is a record too.
    """
    from cartulary import calls, storage
    from cartulary.classify import asker, finished, prepared
    from cartulary.operators.evaluate import strict_matches
    from cartulary.vocabulary import get

    if len(models) > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} models")
    spark, v = documents.sparkSession, options.pop("vocabulary", None) or get()
    told = {k: options.pop(k) for k in ("template", "attempts", "wait", "most_wait") if k in options}
    shape = {k: options.pop(k) for k in ("mode", "naming") if k in options}
    ready = prepared(documents, options.pop("cap", 20_000)).withColumnRenamed("path", "document")
    rows = spark.createDataFrame(list(dict.fromkeys(models)), "provider string, model string")
    path = log or f"{storage.shared_folder(spark)}/calls-{uuid.uuid4().hex}"
    logged = calls.log(ready, rows, path, asker(make, menu=v.menu(), **told), again=again, **options)
    # a log may hold more than this experiment's pairs
    asked = logged.join(F.broadcast(rows), ["provider", "model"], "left_semi").join(ready.select("document", "loader_latency_ms", "loader_backend"), "document").withColumnRenamed("document", "path")
    done = finished(asked, v, keep=("provider", "model"), **shape)
    result = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f))])
    out = done.select(
        F.lit(name).alias("experiment"), F.lit(stamp).alias("timestamp"), F.col("path").alias("document"), "provider", "model",
        F.col("metrics.latency_ms").cast("int").alias("latency_ms"), (~F.col("error")).alias("success"), F.when(~F.col("error"), result).alias("result"), "error_code", "error_message",
    )
    none = F.lit(None).cast("map<string,string>")
    out = out.join(expected, "document", "left") if expected is not None else out.withColumn("expected", none)
    of = lambda c: {f: F.try_element_at(c, F.lit(f)) for f in FIELDS}
    matches = F.when(F.col("success") & F.col("expected").isNotNull(), strict_matches(of("expected"), of("result")))
    return out.withColumn("matches", matches).withColumn("all_match", all_match("matches"))


def all_match(matches):
    return F.coalesce(F.forall(F.map_values(matches), lambda x: x), F.lit(False))


def _right(field: str):
    return F.coalesce(F.try_element_at("matches", F.lit(field)), F.lit(False)).cast("double")


def accuracy_by_model(records: DataFrame) -> DataFrame:
    """A row for each model with a success: the share of each field that is right; records without matches count as wrong."""
    won = records.where("success")
    return won.groupBy("provider", "model").agg(F.count("*").alias("n"), *[F.avg(_right(f)).alias(f"{f}_accuracy") for f in FIELDS], F.avg(F.coalesce("all_match", F.lit(False)).cast("double")).alias("all_accuracy"))


def accuracy_by_field(records: DataFrame) -> DataFrame:
    """(field, correct, total, accuracy) over all successes, and ALL."""
    each = [F.struct(F.lit(f).alias("field"), _right(f).alias("right")) for f in FIELDS] + [F.struct(F.lit("ALL").alias("field"), F.coalesce("all_match", F.lit(False)).cast("double").alias("right"))]
    long = records.where("success").select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return long.groupBy("field").agg(F.sum("right").cast("long").alias("correct"), F.count("*").alias("total"), F.avg("right").alias("accuracy"))


def latency(records: DataFrame, *keys: str) -> DataFrame:
    """Order statistics of the successes' whole milliseconds: upper median, 95th, floored mean, largest.

    Values are counted before they are ranked, so a hot group is as many rows as it has distinct latencies.
    """
    keys = keys or ("provider", "model")
    counted = records.where("success").groupBy(*keys, "latency_ms").agg(F.count("*").alias("c"))
    over = f"PARTITION BY {', '.join(keys)}"
    seated = counted.withColumns({"upto": F.expr(f"sum(c) OVER ({over} ORDER BY latency_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), "n": F.expr(f"sum(c) OVER ({over})")})
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("latency_ms")))
    return seated.groupBy(*keys).agg(
        F.max("n").alias("n"),
        at(F.expr("n div 2")).alias("p50"),
        at(F.expr("least(floor(n * 0.95D), n - 1)")).alias("p95"),
        F.expr("sum(latency_ms * c) div sum(c)").alias("mean"),
        F.max("latency_ms").alias("max"),
    )


def summary(records: DataFrame) -> DataFrame:
    """One row: runs, successes, failures, documents, models, and the exit code these make."""
    won, lost = F.count_if("success"), F.count_if(~F.col("success"))
    return records.agg(
        F.count("*").alias("total"),
        won.alias("successful"),
        lost.alias("failed"),
        F.countDistinct("document").alias("documents"),
        F.countDistinct("provider", "model").alias("models"),
        exit_code(won, lost).alias("exit_code"),
    )


def exit_code(won, lost):
    """0: no failure (or nothing to do); 1: some; 2: nothing but failures."""
    return F.when(lost == 0, 0).when(won > 0, 1).otherwise(2)


def mismatches(records: DataFrame) -> DataFrame:
    """(document, provider, model, field, expected, got) of every wrong field of a success."""
    wrong = records.where("success AND NOT coalesce(all_match, false)")
    return wrong.select("document", "provider", "model", F.explode("matches").alias("field", "right"), "expected", "result").where("NOT right").select("document", "provider", "model", "field", F.try_element_at("expected", "field").alias("expected"), F.try_element_at("result", "field").alias("got"))


def names(records: DataFrame) -> DataFrame:
    """(kind, name, n): the models (provider/model) and the documents of some records, and how many records each has."""
    model, document = F.struct(F.lit("model").alias("kind"), F.concat_ws("/", "provider", "model").alias("name")), F.struct(F.lit("document").alias("kind"), F.col("document").alias("name"))
    each = records.select(F.explode(F.array(model, document)).alias("x")).select("x.*")
    return each.where("name IS NOT NULL").groupBy("kind", "name").agg(F.count("*").alias("n"))


def listed(df: DataFrame, most: int = REPORTED) -> list:
    """Rows for a report that a person reads; more than ``most`` are an error, and belong in a table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows for a report: write them as a table instead (names, mismatches, csv_rows)")
    return rows


def json_report(records: DataFrame) -> dict:
    """The report as one object: counts, models, documents, accuracy by model and by field, latency, mistakes."""
    known = names(records)
    models, documents = ([r["name"] for r in listed(known.where(F.col("kind") == k).orderBy("name"))] for k in ("model", "document"))
    rows = lambda df: [r.asDict() for r in listed(df)]
    first = records.select("experiment", "timestamp").first()
    head = {"experiment": first and first["experiment"], "timestamp": first and first["timestamp"], "models": models, "documents": documents}
    return head | {
        "summary": summary(records).first().asDict(),
        "accuracy_by_model": rows(accuracy_by_model(records).orderBy("provider", "model")),
        "accuracy_by_field": rows(accuracy_by_field(records).orderBy("field")),
        "latency_ms": rows(latency(records).orderBy("provider", "model")),
        "mismatches": rows(mismatches(records).orderBy("document", "provider", "model", "field")),
    }


def csv_rows(records: DataFrame) -> DataFrame:
    """The columns of the CSV report: booleans in lower case, blanks where there are no matches."""
    from cartulary.functions.text import basename

    flag = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return records.select(
        basename(F.col("document")).alias("document"), *[flag(F.col(c)).alias(c) for c in ("provider", "model", "success", "latency_ms")],
        *[flag(F.try_element_at("matches", F.lit(f))).alias(f"match_{f}") for f in FIELDS], flag(F.coalesce("all_match", F.lit(False))).alias("all_match"),
    )


def text_report(records: DataFrame, width: int = 80) -> str:
    """The aggregates as text; only rows of models, fields, failures and mismatches come to the driver."""
    if not records.limit(1).count():
        return "No results to report."
    s = summary(records).first()
    first = records.select("experiment", "timestamp").first()
    line = lambda c: c * width
    out = [line("="), f"Experiment: {first['experiment']}", f"Run: {str(first['timestamp'])[:19].replace('T', ' ')}", line("="), "", "Overview:"]
    out += [f"  {k}: {s[v]}" for k, v in (("Documents", "documents"), ("Models", "models"), ("Total runs", "total"), ("Successful", "successful"), ("Failed", "failed"))]
    out += ["", line("-"), "Accuracy by model (%)", line("-")]
    for r in accuracy_by_model(records).orderBy("provider", "model").toLocalIterator():
        out.append(f"  {r['provider'] + '/' + r['model']:<40}" + "".join(f" {100 * r[f'{f}_accuracy']:>5.0f}%" for f in (*FIELDS, "all")))
    out += ["", line("-"), "Accuracy by field", line("-")]
    fields = {r["field"]: r for r in accuracy_by_field(records).collect()}
    out += [f"  {f:<12} {100 * fields[f]['accuracy']:>5.0f}% ({fields[f]['correct']}/{fields[f]['total']})" for f in (*FIELDS, "ALL") if f in fields]
    out += ["", line("-"), "Latency by model (ms): p50, p95, mean, max", line("-")]
    for r in latency(records).orderBy("provider", "model").toLocalIterator():
        out.append(f"  {r['provider'] + '/' + r['model']:<40}" + "".join(f" {r[c]:>8}" for c in ("p50", "p95", "mean", "max")))
    return "\n".join([*out, "", line("=")])
