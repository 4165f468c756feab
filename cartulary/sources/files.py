"""Document files: which are taken, and their pages."""

from __future__ import annotations

import html
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import text
from cartulary.operators import sampling

# Extensions that are taken, with their types.
TYPES = {
    ".pdf": "application/pdf",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".html": "text/html",
    ".htm": "text/html",
    ".csv": "text/csv",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
}
LOAD_FAILED = "DOCUMENT_LOAD_FAILED"


def extension(path: Column) -> Column:
    return F.lower(text.suffix(path))


def mime_type(path: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), extension(path))


def found(spark: SparkSession, root: str, hidden: bool = False) -> DataFrame:
    """Files of a folder and those in it that are of a taken type, by path.

    hidden: also those whose name, or a folder's on the way, begins with a dot or an underscore; Spark passes these over, so
    the driver lists them itself.
    """
    if hidden:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        listing, rows = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
        while listing.hasNext():
            status = listing.next()
            rows.append((status.getPath().toString(), status.getLen()))
        files = spark.createDataFrame(rows, "path string, length long")
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return files.where(extension(F.col("path")).isin(*TYPES)).dropDuplicates(["path"]).orderBy("path")


def _text_pages(data: bytes) -> list[str]:
    return data.decode("utf-8").split("\f")


def _html_pages(data: bytes) -> list[str]:
    body = re.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)", " ", data.decode("utf-8", "replace"))
    lines = html.unescape(re.sub(r"<[^<>]*>", "\n", body)).split("\n")
    return ["\n".join(x.strip() for x in lines if x.strip())]


@dataclass(frozen=True)
class Parser:
    """A plug-in: bytes to Markdown pages, and whether it can work here (its library and models are there)."""

    parse: Callable[[bytes], list[str]]
    available: Callable[[], bool] = lambda: True
    name: str = "built-in"


#: Parsers by extension.  Others (PDF, office files, images) are plugged in; a file without an available one fails.
PARSERS: dict[str, Parser] = {".txt": Parser(_text_pages), ".md": Parser(_text_pages), ".csv": Parser(_text_pages), ".html": Parser(_html_pages), ".htm": Parser(_html_pages)}
PAGES = "path string, page_no int, page_count int, content string, error_message string, backend string, latency_ms double"


def unavailable(parsers: dict[str, Parser] | None = None) -> list[str]:
    """Extensions whose parser cannot work, asked once on the driver before any file is read."""
    return sorted(e for e, p in (parsers or PARSERS).items() if not p.available())


def pages(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(path, content bytes) -> a row for each page, or one with an error.  Cheap checks come before the bytes are parsed."""
    known = parsers or PARSERS
    missing = unavailable(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                found = re.search(r"\.[^./]+$", path)
                ext = found[0].lower() if found else ""
                began = time.monotonic()
                try:
                    if ext not in known or ext in missing:
                        raise LookupError(f"no parser for {path}" if ext not in known else f"the parser {known[ext].name} is not available")
                    out, error = known[ext].parse(bytes(data)), None
                except Exception as e:  # a document that cannot be read is a row
                    out, error = [None], str(e) if isinstance(e, LookupError) else f"{type(e).__name__}: {e}"
                took = 1000 * (time.monotonic() - began)
                rows += [(path, i, len(out), p, error, known[ext].name if ext in known else None, took) for i, p in enumerate(out or [""], 1)]
            yield pd.DataFrame(rows, columns=["path", "page_no", "page_count", "content", "error_message", "backend", "latency_ms"])

    return files.where(extension(F.col("path")).isin(*TYPES)).select("path", "content").mapInPandas(run, PAGES)


def documents(spark: SparkSession, root: str, strategy: str = "adaptive", most: int = 10, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Load a folder, each file parsed once: path, content, pages_sampled, page_count, error_code and _message, loader_backend, loader_latency_ms, mime_type.

    Sampled pages are joined; a document without text has failed to load.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return loaded(pages(raw, parsers), strategy, most)


def loaded(read: DataFrame, strategy: str = "adaptive", most: int = 10) -> DataFrame:
    """The documents of some pages, as ``documents`` returns them."""
    some = read.where(F.col("error_message").isNotNull() | sampling.sampled(F.col("page_no"), F.col("page_count"), strategy, most))
    also = [F.max(c).alias(n) for c, n in (("page_count", "page_count"), ("error_message", "error_message"), ("backend", "loader_backend"), ("latency_ms", "loader_latency_ms"))]
    joined = sampling.joined_pages(some.withColumn("content", F.coalesce("content", F.lit(""))), "path", "page_no", "content", *also)
    blank = F.col("error_message").isNull() & (text.strip(F.col("content")) == "")
    joined = joined.withColumn("error_message", F.when(blank, F.lit("no text in the document")).otherwise(F.col("error_message")))
    return joined.withColumns({"mime_type": mime_type(F.col("path")), "error_code": F.when(F.col("error_message").isNotNull(), LOAD_FAILED)})
