"""Pages of documents: which are read, and how they join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions.text import strip

STRATEGIES = ("full", "first_n", "bookends", "adaptive")


def sampled(page: Column, count: Column, strategy: str, most: int = 10) -> Column:
    """Whether page (from 1) of ``count`` is read.  All are if there are no more than ``most``.

    first_n: the first ``most``; bookends: the first half, rounded up, and the last, rounded down (none if that is zero);
    adaptive: full up to 5 pages, first_n up to 20, else bookends.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    head, tail = most - most // 2, most // 2
    first, ends = page <= most, (page <= head) | (page > count - tail)
    rule = {"full": F.lit(True), "first_n": first, "bookends": ends, "adaptive": F.when(count <= 5, True).when(count <= 20, first).otherwise(ends)}[strategy]
    return (count <= most) | rule


def joined_pages(pages: DataFrame, key: str = "path", page: str = "page_no", text: str = "content", *also: Column) -> DataFrame:
    """The pages that are not blank, in order, with an empty line between; how many pages were read; and other aggregates.

    A document's pages meet in one row, so its sampling bounds them.
    """
    full = F.filter(F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))), lambda x: strip(x["t"]) != "")
    return pages.groupBy(key).agg(F.array_join(F.transform(full, lambda x: x["t"]), "\n\n").alias("content"), F.count("*").alias("pages_sampled"), *also)
