"""A data source of documents' pages: files are dealt to tasks by size, and read in the workers page by page.

``pages`` gives the rows of ``files.pages`` without a file ever being one value in the JVM or an Arrow batch.  Text is read in
blocks, once to count pages and to find what is wrong, once to hand them on, so a worker holds one page and one block.  Text of
more bytes than a task's is cut into ranges, each a task's work: a page belongs to the range that it begins in, and its number
follows from the counts of the ranges before.  Web pages and what plugged-in parsers read are one value in the worker.  Files are
reached through ``pyarrow.fs`` (local, S3, GCS, HDFS).
"""

from __future__ import annotations

import codecs
import re
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartulary.calls import opened
from cartulary.sources import files
from cartulary.storage import held

#: Bytes of files that a task reads, about, and of a block.
TASK, BLOCK = 128_000_000, 1_000_000
#: Types that are read in blocks.
STREAMED = frozenset((".txt", ".md", ".csv"))
#: Rows of the source; ``start`` is null where a document is read as a whole, and ``page_no`` then its page's number in it.
ROWS = "path string, start long, " + files.PAGES.removeprefix("path string, ")
HIDDEN = re.compile(r"(^|/)[._][^/]*")


class Files(InputPartition):
    """Files that are read as a whole, and ranges of bytes (path, start, end) of others; end is None at the end of the text."""

    def __init__(self, paths: list[str], ranges: list[tuple[str, int, int | None]] = ()):
        self.paths, self.ranges = paths, ranges


def dealt(sizes: list[tuple], task: int = TASK) -> list[list]:
    """Files in groups of about ``task`` bytes, the largest first; a larger file is a group of its own."""
    out: list[list] = []
    room = 0
    for path, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        if not out or size > room:
            out.append([])
            room = task
        out[-1].append(path)
        room -= size
    return out


def _extension(path: str) -> str:
    found = re.search(r"\.[^./]+$", path)
    return found[0].lower() if found else ""


def text_pages(stream, block: int = BLOCK) -> Iterator[str]:
    """Pages of UTF-8 text between form feeds, with one block and one page in memory."""
    decode = codecs.getincrementaldecoder("utf-8")().decode
    held: list[str] = []
    while True:
        data = stream.read(block)
        first, *more = decode(data, final=not data).split("\f")
        held.append(first)
        for piece in more:
            yield "".join(held)
            held = [piece]
        if not data:
            yield "".join(held)
            return


def blocks(system: fs.FileSystem, pieces: list[tuple[str, int]], at: int, block: int = BLOCK) -> Iterator[bytes]:
    """The bytes of files (path, size), one after the other, from the place ``at`` on."""
    for path, size in pieces:
        if at >= size:
            at -= size
            continue
        with system.open_input_file(path) as stream:
            stream.seek(at)
            at = 0
            while data := stream.read(block):
                yield data


def range_pages(read, start: int, end: int | None) -> Iterator[bytes]:
    """Pages that begin from ``start`` on and before ``end``, whole; read(place): the text's blocks from a place on."""
    # a page begins at the text's start or after a form feed, which is no part of a longer UTF-8 sequence
    at, page = max(start - 1, 0), None if start else []
    for data in read(at):
        for i, piece in enumerate(data.split(b"\f")):
            if i:
                at += 1
                if page is not None:
                    yield b"".join(page)
                page = []
                if end is not None and at >= end:
                    return
            at += len(piece)
            if page is not None:
                page.append(piece)
        if page is None and end is not None and at >= end:
            return
    if page is not None:
        yield b"".join(page)


def _shown(system: fs.FileSystem, path: str) -> str:
    return f"file:{path}" if isinstance(system, fs.LocalFileSystem) else path


class PageReader(DataSourceReader):
    def __init__(self, path: str, task: int, block: int, pieces: bool = False, counts: bool = False):
        self.path, self.task, self.block, self.pieces, self.counts = path, task, block, pieces, counts

    def partitions(self) -> list[Files]:
        system, root = opened(self.path)
        listed = system.get_file_info(fs.FileSelector(root, recursive=True))
        whole, cut = [], {}
        for i in listed:
            if i.is_file and _extension(i.path) in files.TYPES and not HIDDEN.search(i.path[len(root) :]):
                if _extension(i.path) in STREAMED and (self.pieces or i.size > self.task):
                    path = i.path.rpartition("/")[0] if self.pieces else i.path
                    cut[path] = cut.get(path, 0) + i.size
                else:
                    whole.append((i.path, i.size))
        # what lies in the last range, also a page that begins where the text ends, has no end
        ranges = [((path, a, a + self.task if a + self.task < size else None), min(self.task, size - a)) for path, size in cut.items() for a in range(0, max(size, 1), self.task)]
        of_ranges = [Files([], x) for x in dealt(ranges, self.task)]
        return (of_ranges if self.counts else [Files(x) for x in dealt(whole, self.task)] + of_ranges) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.path)
        for path in partition.paths:
            for row in self.of_file(system, path):
                yield (row[0], None, *row[1:])
        for one in partition.ranges:
            yield from (self.counted if self.counts else self.of_range)(system, *one)

    def text(self, system: fs.FileSystem, path: str):
        """What ``range_pages`` reads a text by: a file, or the files right in a folder by their names."""
        listed = system.get_file_info(fs.FileSelector(path) if self.pieces else [path])
        pieces = sorted((i.path, i.size) for i in listed if not self.pieces or i.is_file and _extension(i.path) in STREAMED and not HIDDEN.match(i.base_name))
        return lambda at: blocks(system, pieces, at, self.block)

    def parser(self, path: str) -> str:
        return files.PARSERS[".txt" if self.pieces else _extension(path)].name

    def counted(self, system: fs.FileSystem, path: str, start: int, end: int | None) -> Iterator[tuple]:
        """How many pages a range has, as ``page_count``, or what is wrong with its text."""
        n, error, began = 0, None, time.monotonic()
        try:
            for page in range_pages(self.text(system, path), start, end):
                page.decode("utf-8")
                n += 1
        except (OSError, UnicodeDecodeError) as e:
            error = f"{type(e).__name__}: {e}"
        yield (_shown(system, path), start, None, n, None, error, self.parser(path), 1000 * (time.monotonic() - began))

    def of_range(self, system: fs.FileSystem, path: str, start: int, end: int | None) -> Iterator[tuple]:
        """The pages of a range, numbered in it; rows of texts in which something is wrong are passed over later."""
        shown, name, n = _shown(system, path), self.parser(path), 0
        try:
            for page in range_pages(self.text(system, path), start, end):
                n += 1
                yield (shown, start, n, None, page.decode("utf-8", "replace"), None, name, None)
        except OSError as e:
            yield (shown, start, n + 1, None, None, f"{type(e).__name__}: {e}", name, None)

    def of_file(self, system: fs.FileSystem, path: str) -> Iterator[tuple]:
        shown, ext, began = _shown(system, path), _extension(path), time.monotonic()
        name = files.PARSERS[ext].name if ext in files.PARSERS else None
        try:
            if ext not in files.PARSERS or not files.PARSERS[ext].available():
                raise LookupError(f"no parser for {shown}" if ext not in files.PARSERS else f"the parser {name} is not available")
            if ext in STREAMED:
                with system.open_input_stream(path) as stream:
                    count = sum(1 for _ in text_pages(stream, self.block))
                pages = None
            else:
                with system.open_input_stream(path) as stream:
                    pages = files.PARSERS[ext].parse(stream.read())
                count = len(pages)
        except Exception as e:  # a document that cannot be read is a row
            yield (shown, 1, 1, None, str(e) if isinstance(e, LookupError) else f"{type(e).__name__}: {e}", name, 1000 * (time.monotonic() - began))
            return
        took = 1000 * (time.monotonic() - began)
        if pages is not None:
            for i, page in enumerate(pages or [""], 1):
                yield (shown, i, max(count, 1), page, None, name, took)
            return
        with system.open_input_stream(path) as stream:
            for i, page in enumerate(text_pages(stream, self.block), 1):
                yield (shown, i, count, page, None, name, took)


class PagedDocuments(DataSource):
    """Options: path, taskBytes, blockBytes; pieces: the files of a folder are one text; counts: pages of ranges instead of pages."""

    @classmethod
    def name(cls) -> str:
        return "paged_documents"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> PageReader:
        o = self.options
        return PageReader(o["path"], int(o.get("taskBytes", TASK)), int(o.get("blockBytes", BLOCK)), o.get("pieces") == "true", o.get("counts") == "true")


def pages(spark: SparkSession, root: str, task: int = TASK, block: int = BLOCK, pieces: bool = False) -> DataFrame:
    """The pages of a folder's files, as ``files.pages`` returns them; pages of texts larger than a task's are counted at once.

    pieces: text files right in one folder are one document in the order of their names, and a page may run on from one to the next.
    """
    spark.dataSource.register(PagedDocuments)
    read = lambda counts: spark.read.format("paged_documents").options(path=root, taskBytes=task, blockBytes=block, pieces=pieces, counts=counts).load()
    rows = read(False)
    if not any(p.ranges for p in PageReader(root, task, block, pieces).partitions()):
        return rows.drop("start")
    of_text = Window.partitionBy("path")
    wrong, before = F.col("error_message"), F.sum("page_count").over(of_text.orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each range
    starts = held(read(True)).select(
        "path", "start", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("page_count").over(of_text).alias("_pages"),
        F.min_by(wrong, F.when(wrong.isNotNull(), F.col("start"))).over(of_text).alias("_wrong"), F.sum("latency_ms").over(of_text).alias("_took"),
    )
    rows = rows.join(F.broadcast(starts), ["path", "start"], "left")
    good, ranged = F.col("_wrong").isNull(), F.col("start").isNotNull()
    # a text that could be counted and then not be read fails its task, which is tried again
    lost = F.when(good & ranged & wrong.isNotNull(), F.raise_error(wrong).cast("boolean"))
    return rows.where(F.coalesce(lost, good | (F.col("start") == 0) & (F.col("page_no") == 1))).select(
        "path", F.when(good, F.col("page_no") + F.coalesce("_before", F.lit(0))).otherwise(1).cast("int").alias("page_no"), F.when(good, F.coalesce("_pages", "page_count")).otherwise(1).cast("int").alias("page_count"),
        F.when(good, F.col("content")).alias("content"), F.coalesce("_wrong", "error_message").alias("error_message"), "backend", F.coalesce("_took", "latency_ms").alias("latency_ms"),
    )
