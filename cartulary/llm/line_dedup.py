"""Line dedup in DataFrame and SQL functions only: hashes of lines by range, first occurrences, a keep bitmap for each document.

A line's key is the line without white space at its ends and with A-Z in lower case.  Keys of at least ``least_chars`` code
points that ``least_docs`` documents hold are boilerplate: their lines go, except in the first document in the order of
the secondary sort, which is by descending id.  Lines leave the text behind at once and travel as two 64-bit hashes, id and
position: they are dealt by ranges of the hashes and sorted by hash, document and position, and one pass over that order
tells first occurrences.  What returns to a document is a bitmap in words of 64 lines, of which only those with a dropped
line exist; the text is cut only if a caller reads ``kept``.

A key with more than one in HOT of all lines (so there are fewer than HOT of them) isn't dealt at all: its number of documents and
its first document are worked out by partial aggregation and broadcast, and its lines are settled where they lie.

Defined results: a null or empty text is one empty line; lines end at \\n only, and white space is the six ASCII characters;
rows of one id are one document when documents are counted (rows without an id too, which come last in the order), and
rows alike in id and text get the same bitmap; an empty table gives an empty table; columns of the input pass through, and
those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.common import fresh, stored_at
from cartulary.llm.quality_rules import let

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys with more than one in HOT of all lines are hot.  Buckets, many more than HOT, find out which keys may be.
HOT, BUCKETS = 10_000, 1 << 17
KEY = ["h1", "h2"]
#: n_dropped and ``keep``: words of 64 lines with a dropped one, least first; bit i of a word stands for its line i and is 1 if that is kept.
KEEP = "array<struct<word:int,bits:bigint>>"


def lines(df: DataFrame, text: str, doc: str, least_chars: int) -> DataFrame:
    """(doc, row, at, h1, h2) of each line whose key is long enough."""
    row = F.xxhash64(F.col(doc), F.col(text))
    each = df.select(F.col(doc).alias("doc"), row.alias("row"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line"))
    key = each.select("doc", "row", "at", F.translate(F.btrim("line", F.lit(SPACE)), UPPER, LOWER).alias("key"))
    return key.where(F.length("key") >= least_chars).select("doc", "row", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def hot_keys(found: DataFrame, hot: int = HOT) -> DataFrame:
    """The keys with more than one in ``hot`` of all lines; keys are counted only in buckets that hold so many."""
    bucket = F.pmod("h1", F.lit(BUCKETS))
    counted = found.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    # one row: the number of lines
    limit = F.broadcast(counted.agg((F.expr(f"coalesce(sum(n), 0) div {hot}") + 1).alias("limit")))
    full = counted.join(limit, F.col("n") > F.col("limit")).select("bucket")
    inside = found.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi")
    return inside.groupBy(*KEY).agg(F.count("*").alias("n")).join(limit, F.col("n") > F.col("limit")).select(*KEY)


def dropped(found: DataFrame, least_docs: int, hot: int = HOT) -> DataFrame:
    """(doc, row, at) of the lines that go."""
    heavy, _ = stored_at(hot_keys(found, hot))
    # fewer than ``hot`` rows each
    few = F.broadcast(heavy)
    ranked = found.join(few, KEY, "left_anti").repartitionByRange(*KEY)
    within = Window.partitionBy(*KEY)
    seat = F.dense_rank().over(within.orderBy(F.col("doc").desc_nulls_last()))
    cool = ranked.sortWithinPartitions(*KEY, F.col("doc").desc_nulls_last(), "at").withColumn("seat", seat).withColumn("docs", F.max("seat").over(within))
    held = found.join(few, KEY, "left_semi").select(*KEY, "doc").groupBy(*KEY, "doc").agg(F.lit(1).alias("one"))
    first = held.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc").alias("first")).where(F.col("docs") >= least_docs)
    warm = found.join(F.broadcast(first), KEY).where(~F.col("doc").eqNullSafe(F.col("first")))
    return cool.where((F.col("docs") >= least_docs) & (F.col("seat") > 1)).select("doc", "row", "at").unionByName(warm.select("doc", "row", "at"))


def bitmaps(gone: DataFrame) -> DataFrame:
    """(doc, row, n_dropped, keep) of the documents that lose a line."""
    word, bit = F.expr("CAST(at DIV 64 AS INT)"), F.expr("shiftleft(1L, CAST(at % 64 AS INT))")
    words = gone.groupBy("doc", "row", word.alias("word")).agg(F.bit_or(bit).alias("off"))
    one = F.struct("word", F.bitwise_not("off").alias("bits"))
    return words.groupBy("doc", "row").agg(F.sum(F.bit_count("off").cast("long")).alias("n_dropped"), F.sort_array(F.collect_list(one)).alias("keep"))


def kept_lines(text: str, keep: str, n_lines: str) -> F.Column:
    """The lines of ``text`` that the bitmap ``keep`` leaves, joined by \\n; all of them where it is null."""
    off = f"flatten(transform({keep}, w -> transform(filter(sequence(0, 63), b -> (shiftright(w.bits, b) & 1L) = 0L), b -> CAST(64 * w.word + b AS BIGINT))))"
    on = f"array_except(sequence(0L, {n_lines} - 1), {off})"
    cut = let("l", f"split({text}, '\\n', -1)", f"array_join(transform({on}, i -> l[CAST(i AS INT)]), '\\n')")
    return F.expr(f"CASE WHEN {keep} IS NULL THEN {text} ELSE {cut} END")


def dedup(df: DataFrame, text: str = "text", doc: str = "doc_id", least_chars: int = 20, least_docs: int = 3, hot: int = HOT) -> DataFrame:
    """Every row with n_lines, n_dropped, its bitmap ``keep`` (null: all lines stay) and ``kept``, its text without the dropped lines, in place of the text."""
    rest = [c for c in df.columns if c != text and c.lower() not in ("n_lines", "n_dropped", "keep", "kept")]
    t, row, its_doc, its_row = fresh(df, "t", "row", "its_doc", "its_row")
    source = df.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t))
    found, _ = stored_at(lines(source, t, doc, least_chars))
    maps = bitmaps(dropped(found, least_docs, hot)).withColumnsRenamed({"doc": its_doc, "row": its_row})
    rows = source.withColumn(row, F.xxhash64(F.col(doc), F.col(t))).withColumn("n_lines", F.size(F.split(F.col(t), "\n", -1)).cast("long"))
    met = rows.join(maps, (F.col(row) == F.col(its_row)) & F.col(doc).eqNullSafe(F.col(its_doc)), "left")
    return met.select(*[F.col(f"`{c}`") for c in rest], "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.col("keep").cast(KEEP), kept_lines(f"`{t}`", "keep", "n_lines").alias("kept"))
