"""Commands: classify, tag, organise, evaluate, experiment, report, harvest, discover, dashboard, plan, version-check.

Each is a DataFrame plan and a sink.  Whatever asks a model is held once before it is read, so a document costs one call.
"""

from __future__ import annotations

import argparse
import datetime
import json
import logging
import os
import sys
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary import backends, config, prompts
from cartulary.classify import Keywords, classify, invoke, outcome
from cartulary.functions import tags, text
from cartulary.functions.json import parsed
from cartulary.operators import canonicalise, dashboard, evaluate, experiments, harvest
from cartulary.plans import actions, coverage
from cartulary.sources import files, lines, structure
from cartulary.storage import held, spooled
from cartulary.vocabulary import get

GATE = 0.5
LEVELS = {"quiet": logging.ERROR, "verbose": logging.INFO, "debug": logging.DEBUG}
log = logging.getLogger("cartulary")


class JsonLines(logging.Formatter):
    """A log record as one line of JSON."""

    def format(self, record: logging.LogRecord) -> str:
        at = datetime.datetime.fromtimestamp(record.created, datetime.UTC).isoformat()
        return json.dumps({"timestamp": at, "level": record.levelname.lower(), "event": record.getMessage(), **getattr(record, "fields", {})})


def _logging(level: str) -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonLines())
    log.handlers, log.propagate = [handler], False
    log.setLevel(LEVELS.get(level, logging.ERROR))


def _tell(event: str, **fields) -> None:
    log.info(event, extra={"fields": fields})


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cartulary", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--config")
    shared.add_argument("--backend", choices=("keywords", "provider"), default="keywords", help="keywords: the stand-in for tests; provider: the language model that is set")
    shared.add_argument("--url", help="another address of the provider")
    for name in ("ai-provider", "ai-model", "taxonomy", "taxonomy-mode", "naming-style", "sample-strategy", "on-error", "log-level", "prompt", "debug-dir"):
        shared.add_argument(f"--{name}")
    for name in ("ai-max-tokens", "max-pages", "concurrency"):
        shared.add_argument(f"--{name}", type=int)
    for name in ("metrics", "capture-debug", "debug-structure"):
        shared.add_argument(f"--{name}", action="store_true", default=None)

    def command(name: str, *arguments: str, parents=(shared,)) -> argparse.ArgumentParser:
        made = commands.add_parser(name, parents=list(parents))
        for a in arguments:
            made.add_argument(a)
        return made

    made = command("classify", "folder")
    made.add_argument("--output")
    made.add_argument("--batch", action="store_true", help="one line of JSON a document, as is always done here")
    made = command("tag", "folder")
    made.add_argument("--tag-fields", default="domain,category,doctype")
    made.add_argument("--tag-mode", choices=tags.MODES, default="add")
    made.add_argument("--tags", help="JSON lines of path and existing_tags")
    made.add_argument("--store", choices=sorted(actions.STORES), help="where the driver reads and writes tags; none: tags are planned only")
    made.add_argument("--dry-run", action="store_true")
    made = command("organise", "folder")
    made.add_argument("--dry-run", action="store_true")
    made.add_argument("--store", choices=sorted(actions.STORES), help="also tag what has been renamed, in this store")
    made.add_argument("--tag-fields", default="domain,category,doctype")
    made.add_argument("--tag-mode", choices=tags.MODES, default="add")
    made = command("evaluate")
    made.add_argument("folder", nargs="?", help="else the folder documents beside the ground truth")
    made.add_argument("--ground-truth", required=True)
    made.add_argument("--output", choices=("summary", "json"), default="json")
    made = command("experiment-run", "manifest")
    made.add_argument("--output")
    made.add_argument("--dry-run", action="store_true")
    made.add_argument("--log", help="folder of the calls made so far, which are not made again; else the output with .calls after it")
    made.add_argument("--retry-failed", action="store_true", help="ask again for what failed in the log")
    command("experiment-validate", "manifest", parents=())
    made = command("report", "records", parents=())
    made.add_argument("--format", choices=("text", "json", "csv"), default="text")
    for name in ("harvest", "discover"):
        made = command(name)
        made.add_argument("answers", help="JSON lines of domain, category, doctype, vendor, date, subject; or a folder of documents, with --documents")
        made.add_argument("--documents", action="store_true")
        made.add_argument("--sample", type=int, default=0)
        made.add_argument("--seed", type=int, default=0)
        made.add_argument("--output")
        made.add_argument("--format", choices=("python", "json"), default="python")
    made = command("dashboard", "runs", "data", parents=())
    made.add_argument("--page")
    made = command("plan", "ground_truth")
    for name, default in (("count", 0), ("min-long", 0), ("documents", 5), ("categories", 3), ("doctypes", 3), ("seed", 0)):
        made.add_argument(f"--{name}", type=int, default=default)
    command("version-check", "project", "module", parents=())
    return parser


def _settings(args) -> config.Settings:
    names = ("taxonomy", "taxonomy_mode", "naming_style", "sample_strategy", "on_error", "log_level", "prompt", "debug_dir", "max_pages", "concurrency", "metrics", "capture_debug", "debug_structure")
    given = {k: getattr(args, k, None) for k in names}
    given |= {k: getattr(args, f"ai_{k}", None) for k in ("provider", "model", "max_tokens")}
    return config.load(getattr(args, "config", None), **given)


def _options(args, s: config.Settings) -> dict:
    """What of the settings goes to every classification."""
    # as many calls as are asked for are open at once: a partition for each core first, then several in each
    parts = min(s.concurrency, SparkSession.active().sparkContext.defaultParallelism)
    options = {"vocabulary": get(s.taxonomy), "mode": s.taxonomy_mode, "partitions": parts if s.concurrency > 1 else None, "width": -(-s.concurrency // parts), "naming": s.naming_style}
    options |= {"attempts": s.max_retries, "wait": s.retry_min_wait, "most_wait": s.retry_max_wait, "stop": s.on_error == "fail", "debug": s.capture_debug}
    return options | ({"template": prompts.load(s.prompt)[1]} if s.prompt else {})


def _maker(args, s: config.Settings):
    v = get(s.taxonomy)
    return backends.maker(s, args.url) if args.backend == "provider" else lambda: Keywords(v)


def _classified(spark: SparkSession, args, documents: DataFrame | None = None) -> tuple[DataFrame, config.Settings]:
    """Results of a folder, held: whatever is done with them, each file is parsed and each document asked once."""
    s = _settings(args)
    _logging(s.log_level)
    documents = files.documents(spark, args.folder, s.sample_strategy, s.max_pages) if documents is None else documents
    if s.debug_dir and s.debug_structure:
        documents = held(documents)  # parsed once, though it is asked about and looked into
        structure.outline(documents.where("error_code IS NULL"), "path").write.mode("append").json(f"{s.debug_dir.rstrip('/')}/structure")
    results = held(classify(documents, _maker(args, s), model=s.model if args.backend == "provider" else None, **_options(args, s)))
    if s.debug_dir and (s.capture_debug or s.debug_structure):
        captured = results.select("path", "error_code", *(("prompt", "response") if s.capture_debug else ()), *(("metrics",) if s.debug_structure else ()))
        captured.write.mode("append").option("ignoreNullFields", "false").json(f"{s.debug_dir.rstrip('/')}/calls")
    _tell("classified", folder=getattr(args, "folder", None), documents=results.count())
    return results, s


def _print(df: DataFrame) -> None:
    """One line of JSON a row, as rows come; nulls are left out."""
    for row in df.select(F.to_json(F.struct(*df.columns))).toLocalIterator():
        print(row[0])


def _write(content: str, path: str | None) -> None:
    if path:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(content)
    else:
        print(content)


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


def _report(spark: SparkSession, args) -> int:
    rows = lines.records(spark, args.records)
    if args.format == "text":
        print(experiments.text_report(rows))
    elif args.format == "json":
        print(json.dumps(experiments.json_report(rows), indent=2, ensure_ascii=False))
    else:
        out = experiments.csv_rows(rows)
        print(",".join(out.columns))
        for r in out.toLocalIterator():
            print(",".join(r))
    return 0


def _experiment(spark: SparkSession, args) -> int:
    with open(args.manifest, encoding="utf-8") as f:
        raw = f.read()
    name, models, documents = lines.manifest(raw)
    extra = lines.manifest_object(raw).get("config") or {}
    prompt = os.path.expanduser(extra["prompt"]) if extra.get("prompt") else None
    issues = lines.manifest_issues(models, documents, os.path.exists, prompt=prompt)
    for issue in issues:
        print(issue, file=sys.stderr)
    if args.command == "experiment-validate" or issues:
        return int(bool(issues))
    print(f"{name}: {len(documents)} documents, {len(models)} models, {len(documents) * len(models)} runs", file=sys.stderr)
    if args.dry_run:
        return 0
    known = {k: v for k, v in extra.items() if k in ("taxonomy", "taxonomy_mode", "sample_strategy", "max_pages", "max_tokens", "capture_debug", "debug_dir")}
    s = config.load(args.config, **known, prompt=prompt, **{k: v for k in ("on_error", "concurrency") if (v := getattr(args, k)) is not None})
    _logging(s.log_level)
    plain = F.regexp_replace("path", "^file:/+", "/")
    read = files.pages(spark.read.format("binaryFile").load([os.path.abspath(d["path"]) for d in documents]))
    loaded = held(files.loaded(read, s.sample_strategy, s.max_pages).withColumn("path", plain))
    expected = spark.createDataFrame([(os.path.abspath(d["path"]), {k: str(v) for k, v in d["expected"].items()}) for d in documents if d.get("expected")], "document string, expected map<string,string>")

    def make(provider: str, model: str):
        return _maker(args, config.replace(s, provider=provider, model=model))

    # an experiment goes on after failures unless it is told not to
    options = {k: v for k, v in _options(args, s).items() if k != "debug"} | {"stop": args.on_error == "fail"}
    out = args.output or f"eval/results/{name}-{datetime.datetime.now():%Y%m%d-%H%M%S}.jsonl"
    # every call is in the log as it ends: an experiment that was broken off goes on where it stood
    log = os.path.abspath(args.log or f"{out}.calls")
    lines.write_records(experiments.run(loaded, models, make, name, _now(), expected, log=log, again=args.retry_failed, **options), out, "overwrite")
    code = experiments.summary(lines.records(spark, out)).first()["exit_code"]
    return 2 if code and args.on_error == "fail" else code


def _harvest(spark: SparkSession, args) -> int:
    s, schema = _settings(args), ", ".join(f"{c} string" for c in ("domain", "category", "doctype", "vendor", "date", "subject"))
    if args.documents:
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.answers)
        if args.sample > 0:  # of the paths, before any file is read
            few = harvest.sample(raw.where(files.extension(F.col("path")).isin(*files.TYPES)).select("path"), args.sample, args.seed)
            raw = raw.join(F.broadcast(few), "path", "left_semi")
        asked = files.loaded(files.pages(raw), s.sample_strategy, s.max_pages).select("path", text.truncate(F.col("content")).alias("content"), "error_code", "error_message")
        answered = held(invoke(asked, _maker(args, s), menu=get(s.taxonomy).menu(), attempts=s.max_retries, wait=s.retry_min_wait, most_wait=s.retry_max_wait))
        answers = parsed(answered.drop("error_code", "error_message"), "response").select("fields.*")
    else:
        answers = spark.read.schema(schema).json(args.answers)
    rows = harvest.normalised(answers, get(s.taxonomy))
    if args.command == "discover":
        counted = harvest.counters(rows).first()
        _write(harvest.vocabulary_text(harvest.discovered(answers), counted["processed"], counted["errors"], args.format), args.output)
    else:
        _write(json.dumps(harvest.report(rows, f"{s.provider}/{s.model}", s.taxonomy, _now()), indent=2, ensure_ascii=False), args.output)
    return 0


def _dashboard(spark: SparkSession, args) -> int:
    """Merge run folders into the dashboard's data, and splice that into its page."""
    before = open(args.data, encoding="utf-8").read() if os.path.exists(args.data) else None
    found = lines.run_folders(spark, args.runs, dashboard.RUN).join(lines.run_logs(spark, args.runs), "folder", "left")
    new = dashboard.aggregates(dashboard.described(found))
    names = new.columns
    old = spark.createDataFrame([tuple(r.get(c) for c in names) for r in dashboard.existing(before)], new.schema)
    data = dashboard.document(dashboard.merged(old, new), _now())
    _write(data, args.data)
    if args.page:
        with open(args.page, encoding="utf-8") as f:
            page = f.read()
        _write(dashboard.spliced(page, data), args.page)
    return 0


def _version_check(args) -> int:
    """0 if the project file and the module name the same version."""
    with open(args.project, "rb") as f:
        one = tomllib.load(f)["project"]["version"]
    with open(args.module, encoding="utf-8") as f:
        other = next((x.split("=", 1)[1].strip().strip("\"'") for x in f if x.startswith("__version__")), None)
    print(f"{one} and {other}")
    return int(one != other)


def _tag(spark: SparkSession, results: DataFrame, args, s: config.Settings) -> int:
    """Plan tags, and write them if there is a store and this is no dry run."""
    schema, fields = "path string, existing_tags array<string>", tuple(args.tag_fields.split(","))
    good = results.where("NOT error")
    store = actions.STORES[args.store]() if args.store else None
    if store:
        stored = _stored_tags(spark, good, store)
    else:
        stored = spark.read.schema(schema).json(args.tags) if args.tags else spark.createDataFrame([], schema)
    tagger = actions.Tagger(store, args.tag_mode, fields)
    plan = tagger.plan(good.join(stored, "path", "left").withColumn("existing_tags", F.coalesce("existing_tags", F.array().cast("array<string>"))))
    _print(plan.select("path", "final_tags", "description"))
    if store is None or args.dry_run:
        return outcome(results, s.on_error)
    lost = 0
    for d in actions.carry_out(plan, tagger):
        if not d.success:
            lost += 1
            print(json.dumps(vars(d)), file=sys.stderr)
    total = results.count()
    return actions.totals(total, total - good.count(), lost)


def _stored_tags(spark: SparkSession, rows: DataFrame, store) -> DataFrame:
    """(path, existing_tags) of files, read where the driver sees them."""
    read = ({"path": r[0], "existing_tags": store.read(r[0])} for r in rows.select("path").toLocalIterator())
    return spooled(spark, read, "path string, existing_tags array<string>")


def _organise(spark: SparkSession, results: DataFrame, args) -> int:
    """Rename in place and, if there is a store, tag what bears its name now; then say how many were renamed, tagged and passed over.

    Files are renamed and tagged where the driver sees them, one after the other as rows come.
    """
    good, total = results.where("NOT error"), results.count()
    renamer, tagged, plan = actions.Renamer(), {}, None
    counts = dict.fromkeys(("renamed", "tagged", "done", "lost", "untagged"), 0)
    if total:
        plan = renamer.plan(good)
    store = actions.STORES[args.store]() if getattr(args, "store", None) else None
    if plan is not None and store is not None:
        tagger = actions.Tagger(store, args.tag_mode, tuple(args.tag_fields.split(",")))
        # tags stand with a file as it was before; they are planned at once with its name
        plan = plan.join(_stored_tags(spark, good, store), "path", "left")
        plan = tagger.plan(plan.withColumnRenamed("description", "_renames")).withColumnsRenamed({"description": "tag_changes", "_renames": "description"})
        tagged = {"action": tagger}
    for row in plan.toLocalIterator() if plan is not None else ():
        d = actions.one(row, renamer, args.dry_run)
        shown = {k: v for k, v in vars(d).items() if v is not None}
        counts["done"] += 1
        counts["lost"] += not d.success
        counts["renamed"] += d.success and d.description != "already named"
        if tagged and d.success:
            t = actions.one(actions.moved(row), tagged["action"], args.dry_run)
            counts["tagged" if t.success else "untagged"] += 1
            shown |= {"tags": row["tag_changes"]} if t.success else {"tag_error": t.error}
        print(json.dumps(shown))
    skipped = total - counts["done"] + counts["lost"]
    print(json.dumps({"processed": total, "renamed": counts["renamed"], "tagged": counts["tagged"], "skipped": skipped, "dry_run": args.dry_run}))
    return actions.totals(total, total - counts["done"], counts["lost"] + counts["untagged"])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "version-check":
        return _version_check(args)
    spark = spark or SparkSession.builder.appName("cartulary").getOrCreate()
    if args.command in ("report", "dashboard", "harvest", "discover", "experiment-run", "experiment-validate"):
        return {"report": _report, "dashboard": _dashboard, "harvest": _harvest, "discover": _harvest, "experiment-run": _experiment, "experiment-validate": _experiment}[args.command](spark, args)
    if args.command == "plan":
        v = get(_settings(args).taxonomy)
        rows = canonicalise.canonicalise(lines.rows(spark, args.ground_truth), v, "null")
        rows = rows.select(*[F.col(f"canon_{a}").alias(a) for a in canonicalise.AXES])
        planned = coverage.from_nothing(spark, args.count, args.min_long, args.seed, v) if args.count else coverage.three_stages(rows, args.documents, args.categories, args.doctypes, args.seed, v)
        _print(coverage.asked(planned))
        return 0
    if args.command == "evaluate":
        args.folder = args.folder or os.path.join(os.path.dirname(args.ground_truth), "documents")
    results, s = _classified(spark, args)
    if args.command == "organise":
        return _organise(spark, results, args)
    if args.command == "evaluate":
        rows = held(evaluate.compared(results.where("NOT error").withColumnRenamed("original", "filename"), lines.ground_truth(spark, args.ground_truth)))
        score = evaluate.accuracy(rows)
        if args.output == "summary":
            print(evaluate.text_summary(rows, s.provider, s.model))
        else:
            _print(score)
        return int(score.first()["domain_accuracy"] < GATE)
    if args.command == "tag":
        return _tag(spark, results, args, s)
    shown = results.where("NOT error") if s.on_error == "skip" else results
    shown = shown if s.metrics else shown.drop("metrics")
    if args.output:
        lines.write_results(shown, args.output)
    else:
        _print(shown)
    return outcome(results, s.on_error)


if __name__ == "__main__":
    sys.exit(main())
