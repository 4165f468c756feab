"""JSON lines: ground truth, run records; run folders and logs; manifests."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.storage import held

TRUTH = "filename string, domain string, category string, doctype string, vendor string, date string, subject string, notes string"
#: Fields that an entry of ground truth must have.
REQUIRED = ("filename", "domain", "category", "doctype")
RECORD = (
    "experiment string, timestamp string, document string, provider string, model string, latency_ms int, success boolean, result map<string,string>, "
    "error_code string, error_message string, expected map<string,string>, matches map<string,boolean>, all_match boolean"
)


def _entries(raw: DataFrame) -> DataFrame:
    """(line, raw) -> the lines that are objects, with their fields."""
    some = raw.select("line", F.trim("raw").alias("raw")).where("raw <> '' AND NOT startswith(raw, '#')")
    rows = some.select("line", F.from_json("raw", TRUTH + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("line", "r.*")
    return rows.where("_bad IS NULL").drop("_bad")


#: Blocks of files up to which their table is broadcast.
FEW_BLOCKS = 200_000


def numbered(spark: SparkSession, path: str, pieces: bool = False) -> DataFrame:
    """(file, line, raw): the lines of text files with their numbers from 0, however large a file is.

    Files are read in blocks by many tasks.  One pass counts each block's lines; a line's number is the lines of its file's
    earlier blocks and its place in its own, as rows of a block come in order.  pieces: lines are numbered through the files of
    a folder in the order of their names.
    """
    # rows of one read are numbered alike in both passes: blocks are dealt to tasks by sizes of files and settings alone
    read = spark.read.option("lineSep", "\n").text(path)
    raw = read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"))
    blocks = held(raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first")))
    text = "substring_index(file, '/', size(split(file, '/')) - 1)" if pieces else "file"
    before = F.expr(f"coalesce(sum(n) OVER (PARTITION BY {text} ORDER BY file, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    starts = blocks.select("file", "block", (before - F.col("first")).alias("shift"))
    few = F.broadcast(starts) if blocks.count() <= FEW_BLOCKS else starts
    return raw.join(few, ["file", "block"]).select("file", (F.col("id") + F.col("shift")).alias("line"), "raw")


def bad_lines(spark: SparkSession, path: str, shown: int = 80, pieces: bool = False) -> DataFrame:
    """(file, number, reason, start): what readers of ground truth pass over, with its number from 1: no object, or a field that is missing."""
    some = numbered(spark, path, pieces).withColumn("raw", F.trim(F.regexp_replace("raw", r"\r$", ""))).where("raw <> '' AND NOT startswith(raw, '#')")
    read = some.withColumn("r", F.from_json("raw", TRUTH + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    gaps = F.filter(F.array(*[F.when(F.col(f"r.{c}").isNull(), F.lit(c)) for c in REQUIRED]), lambda x: x.isNotNull())
    reason = F.when(F.col("r._bad").isNotNull(), "no object").when(F.size(gaps) > 0, F.concat(F.lit("missing: "), F.array_join(gaps, ", ")))
    return read.select("file", (F.col("line") + 1).alias("number"), reason.alias("reason"), F.substring("raw", 1, shown).alias("start")).where("reason IS NOT NULL")


def truth_of(raw: DataFrame) -> DataFrame:
    """Entries of numbered lines (line, raw), with their ``line``: blank, # and bad lines are skipped; of a repeated filename the last counts."""
    good = _entries(raw).where(" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED))
    fields = [c for c in good.columns if c != "filename"]
    return good.groupBy("filename").agg(F.max_by(F.struct(*fields), "line").alias("r")).select("filename", "r.*")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSONL file, as ``truth_of`` takes them from its lines."""
    return truth_of(numbered(spark, path)).drop("line")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a ground-truth file read tolerantly: any line that is an object, with its number, repeats kept."""
    return _entries(numbered(spark, path))


def append(path: str, record: dict) -> None:
    """Add a line to a file on the driver's disk so that a reader sees all of it or nothing: a sibling is written, then renamed."""
    held = b""
    if os.path.exists(path):
        with open(path, "rb") as f:
            held = f.read()
    if held and not held.endswith(b"\n"):
        held += b"\n"
    with tempfile.NamedTemporaryFile(dir=os.path.dirname(path) or ".", delete=False) as f:
        f.write(held + json.dumps(record).encode() + b"\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Run records; a line that is no record fails."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def write_records(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append, or what ``mode`` says; nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """One line for each document, nulls left out."""
    df.write.mode("append").json(path)


def log_runtime(content: Column) -> Column:
    """Seconds from the first to the last time stamp of a log; null with fewer than two."""
    stamps = F.regexp_extract_all(content, F.lit(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"), F.lit(0))
    n = F.unix_timestamp(F.element_at(stamps, -1)) - F.unix_timestamp(F.element_at(stamps, 1))
    return F.when((F.size(stamps) >= 2) & (n > 0), n)


def run_folders(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """JSON files of the folders right below ``root``, with folder and file names; files that cannot be read are skipped."""
    place = F.split(F.col("_metadata.file_path"), "/")
    bad = schema + ", _bad string"
    held = spark.read.option("multiLine", "true").option("columnNameOfCorruptRecord", "_bad").schema(bad).json(f"{root}/*/*.json")
    # the plan may not read the column of bad files alone, so it is asked beside the others
    return held.withColumns({"file": F.element_at(place, -1), "folder": F.element_at(place, -2)}).where("_bad IS NULL AND file IS NOT NULL").drop("_bad")


def run_logs(spark: SparkSession, root: str) -> DataFrame:
    """(folder, log_seconds) of the .stderr logs beside runs: from the first to the last time stamp of a folder's log."""
    held = spark.read.text(f"{root}/*/*.stderr", wholetext=True)
    place = F.split(F.col("_metadata.file_path"), "/")
    return held.select(F.element_at(place, -2).alias("folder"), log_runtime(F.col("value")).alias("s")).groupBy("folder").agg(F.max("s").cast("double").alias("log_seconds"))


def manifest_object(text: str) -> dict:
    """An experiment in YAML (where that can be imported) or JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def manifest(text: str) -> tuple[str, list[tuple[str, str]], list[dict]]:
    """(name, models, documents) of an experiment in YAML (where that can be imported) or JSON; ~ stands for the home folder."""
    raw = manifest_object(text)
    models = [(m["provider"], m["name"] if "name" in m else m["model"]) for m in raw["models"]]
    return raw["name"], models, [{**d, "path": os.path.expanduser(d["path"])} for d in raw["documents"]]


def manifest_issues(models: list[tuple[str, str]], documents: list[dict], exists, providers=("ollama", "openai", "anthropic", "openrouter"), prompt: str | None = None) -> list[str]:
    """Missing paths, further occurrences of a path, unknown providers, a missing prompt template."""
    seen, out = set(), []
    for d in documents:
        if d["path"] in seen:
            out.append(f"duplicate document: {d['path']}")
        elif not exists(d["path"]):
            out.append(f"document not found: {d['path']}")
        seen.add(d["path"])
    out += [f"unknown provider: {p}" for p, _ in models if p not in providers]
    return out + [f"prompt template not found: {prompt}"] * bool(prompt and not exists(prompt))
