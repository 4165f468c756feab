"""Running sums along one order of all rows, or of each key's, in tasks of bounded size.

A window without a key is one task, and one with a key is one task for each key, however many rows that has.  Here rows are dealt by
ranges of the order, each range sums up its own, the sums before each range are worked out from one number a range, and a window
within the range does the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartulary.storage import held

#: Rows of one key that a single task may sum up.
PER_TASK = 500_000
#: Keys that are dealt by ranges are fewer than this: each has more than one in so many of all rows.
FEW = 10_000
PART = "_range"


def _columns(names) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...], *more: str) -> Column:
    """Equality of keys, where two nulls are equal."""
    each = [left[k].eqNullSafe(right[k]) for k in keys] + [left[m] == right[m] for m in more]
    return reduce(lambda a, b: a & b, each)


def _offsets(totals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, range, total) -> (keys, range, before): the sum of the totals of earlier ranges."""
    if keys:
        # a key has a row for each range at most
        before = F.sum("total").over(Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
        return totals.select(*keys, PART, F.coalesce(before, F.lit(0)).alias("before"))
    # one row: a number for each range, summed up in an array
    kind = totals.schema["total"].dataType.simpleString()
    one = totals.agg(F.sort_array(F.collect_list(F.struct(PART, "total"))).alias("t"))
    step = F.aggregate("t", F.struct(F.lit(0).cast(kind).alias("sum"), F.array().cast(f"array<struct<{PART}:int,before:{kind}>>").alias("out")), lambda a, x: F.struct((a["sum"] + x["total"]).cast(kind).alias("sum"), F.array_append(a["out"], F.struct(x[PART].alias(PART), a["sum"].alias("before"))).alias("out")))
    return one.select(F.explode(step["out"]).alias("o")).select("o.*")


def _by_ranges(df: DataFrame, order: list[Column], amount: str, keys: tuple[str, ...], out: str) -> DataFrame:
    along = [*_columns(keys), *order]
    # which range a row is in must not change between the passes, so it is written down
    dealt = held(df.repartitionByRange(*along).withColumn(PART, F.spark_partition_id()))
    totals = dealt.groupBy(*keys, PART).agg(F.sum(amount).alias("total"))
    offsets = F.broadcast(_offsets(totals, keys))  # a row for each range, and one more for each of few keys
    scan = F.sum(amount).over(Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = dealt.withColumn(out, scan)
    return within.join(offsets, _same(within, offsets, keys, PART)).select(*[within[c] for c in df.columns], (within[out] + offsets["before"]).alias(out))


def running(df: DataFrame, order, amount: str, keys: tuple[str, ...] = (), out: str = "running", per_task: int = PER_TASK) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over this row and those before it, of the same key if there are keys.

    order: one column or several, ascending; equal rows are placed in any order.  Exact for whole numbers and decimals.  Null
    amounts count as nothing, null keys are one key.  A key of at most ``per_task`` rows, or one in FEW of all, is summed up by a
    window; the rows of larger ones, and all rows where there is no key, go by ranges.
    """
    order = _columns([order] if isinstance(order, (str, Column)) else order)
    if not keys:
        return _by_ranges(df, order, amount, (), out)
    counted = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    limit = F.broadcast(counted.agg(F.greatest(F.lit(per_task), F.expr(f"coalesce(sum(_rows), 0) div {FEW}")).alias("_limit")))
    large = held(counted.join(limit, F.col("_rows") > F.col("_limit")).select(*keys))
    plain = F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if large.isEmpty():
        return df.withColumn(out, plain)
    few = F.broadcast(large)
    small = df.join(few, _same(df, few, keys), "left_anti").withColumn(out, plain)
    return small.unionByName(_by_ranges(df.join(few, _same(df, few, keys), "left_semi"), order, amount, keys, out))
