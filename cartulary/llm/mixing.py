"""Mixing sources to target weights by Pfair scheduling.

Every source's documents are dealt into blocks.  With integer weights that add up to P, block k of a source of weight w is
released at slot floor(k * P / w) and due at slot ceil((k + 1) * P / w); in every slot the released block that is due first
goes next.  That keeps each source within less than one block of its target at every slot, and the pattern repeats every P
slots, so a table of P entries gives any block's slot.  When a source has no blocks left, the others go on with their
weights alone, from a new pattern.  No document is dropped.

Weights are given, or follow from the counts: each source gets round(1000 * count ** POWER / sum of those), 1 at least.
The driver sees counts of sources, and tables whose size follows from the number of sources and the sum of weights.

Defined results: a null source is a source of its own; documents within a source go by a hash of id and text, so rows
that are alike in both are interchangeable; null ids and texts are ordinary values; a given weight that is missing or
below one leaves its source for the end, at weight 1 each once all weighted sources have run out; extra columns pass
through, output columns replace input columns of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents in a block; rows that one task ranks within a source, about.
BLOCK, RANKED = 16, 2_000
#: Sources up to which their table is broadcast.
FEW = 50_000
#: Slots up to which their table is broadcast (16 bytes each); blocks of a stretch, by which parts and phases meet.
SLOTS, STRETCH = 100_000, 128
POWER, TOTAL = 0.5, 1000


def pattern(weights: dict[int, int], blocks: dict[int, int] | None = None) -> list[int]:
    """The source of every slot of one period, earliest deadline first among the released.

    blocks: stop after the slot of the block that is a source's last, if that comes within the period.
    """
    period = sum(weights.values())
    due = lambda s, k: -(-(k + 1) * period // weights[s])
    waiting = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        if blocks and k + 1 == blocks[s]:
            return out
        if k + 1 < weights[s]:
            heapq.heappush(waiting, ((k + 1) * period // weights[s], s, k + 1))
    return out


def phases(blocks: dict[int, int], weights: dict[int, int]) -> tuple[list[tuple], list[tuple]]:
    """Rows (phase, source, first block, end block, first slot, period, weight) and (phase, source, j, slot in the period).

    A phase ends with some source's last block.  Only sources that have a block in a phase have rows of it, so there are no
    more rows than blocks, and none beyond the sum of weights for each source.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    used, start, spans, slots = dict.fromkeys(left, 0), 0, [], []
    phase = 0
    while left:
        weighed = {s: weights[s] for s in left if weights.get(s, 0) > 0} or dict.fromkeys(left, 1)
        period = sum(weighed.values())
        order = pattern(weighed, left if any(left[s] <= w for s, w in weighed.items()) else None)
        places: dict[int, list[int]] = {}
        for slot, s in enumerate(order):
            places.setdefault(s, []).append(slot)
        # the phase ends after the slot of the block that is some source's last; a pattern cut short ends with it
        last = len(order) - 1 if len(order) < period else min((left[s] - 1) // w * period + places[s][(left[s] - 1) % w] for s, w in weighed.items())
        whole, part = divmod(last + 1, period)
        for s, own in places.items():
            n = whole * weighed[s] + bisect_left(own, part)
            if n:
                spans.append((phase, s, used[s], used[s] + n, start, period, weighed[s]))
                slots += [(phase, s, j, p) for j, p in enumerate(own[:n])]
                used[s] += n
                left[s] -= n
                if not left[s]:
                    del left[s]
        start, phase = start + last + 1, phase + 1
    return spans, slots


def deviation(order: list[int], weights: dict[int, int]) -> Fraction:
    """The largest distance, in blocks, between what a source got and its share, at any slot of ``order``."""
    period, got, most = sum(weights.values()), dict.fromkeys(weights, 0), Fraction(0)
    for t, s in enumerate(order, 1):
        got[s] += 1
        most = max(most, *(abs(Fraction(t * w, period) - got[x]) for x, w in weights.items()))
    return most


def default_weights(counts: dict) -> dict:
    total = sum(n**POWER for n in counts.values())
    return {s: max(1, floor(TOTAL * n**POWER / total + 0.5)) for s, n in counts.items()}


def mix(df: DataFrame, weights: dict | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``block`` (of its source), ``slot``, ``release`` and ``due`` (slots of its phase) and ``place``, the order to read in."""
    spark, new = df.sparkSession, ("block", "slot", "release", "due", "place")
    rest = [c for c in df.columns if c not in new]
    # the columns of ``df`` travel under numbers, so that none meets a name of these plans and unread ones are pruned
    held_as = {c: f"_c{i}" for i, c in enumerate(rest)}
    df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in held_as.items()], F.col(source).alias("_s"), F.xxhash64(F.col(doc_id).cast("string"), F.coalesce(F.col(text), F.lit(""))).alias("_h"))
    keyed = df
    counted = keyed.groupBy("_s").count().collect()  # a row for each source
    counts = {r["_s"]: r["count"] for r in counted}
    names = sorted(counts, key=lambda s: (s is not None, s))
    number = {s: k for k, s in enumerate(names)}
    held = {number[s]: w for s, w in (default_weights(counts) if weights is None else {s: w for s, w in weights.items() if s in number}).items()}
    spans, slots = phases({number[s]: ceil(n / BLOCK) for s, n in counts.items()}, held)
    kind = df.schema["_s"].dataType.simpleString()
    sources = spark.createDataFrame([(s, k, max(1, ceil(counts[s] / RANKED))) for s, k in number.items()], f"_s {kind}, _k int, _parts int")
    # a source's documents are ranked in parts of bounded size: ranks of hashes within a part, after what the parts before it hold
    part = F.floor((F.shiftrightunsigned("_h", 1) / F.lit(2.0**63)) * F.col("_parts")).cast("int")
    few = F.broadcast if len(names) <= FEW else (lambda d: d)
    parted = keyed.join(few(sources), keyed["_s"].eqNullSafe(sources["_s"])).drop(sources["_s"]).withColumn("_part", F.least(part, F.col("_parts") - 1))
    held_by = parted.groupBy("_k", "_part").agg(F.count("*").alias("_n"))
    before = held_by.select("_k", "_part", "_n", F.expr("coalesce(sum(_n) OVER (PARTITION BY _k ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)").alias("_before"))
    span_rows = spark.createDataFrame(spans, "_phase int, _k int, _from long, _to long, _start long, _period long, _w long")
    # parts, of which there is one for some thousand rows, meet the phases that their blocks are in; rows get those of their part
    stretch = lambda first, last: F.explode(F.expr(f"sequence(({first}) div {STRETCH}, ({last}) div {STRETCH})")).alias("_at")
    in_parts = before.select("_k", "_part", F.expr(f"_before div {BLOCK}").alias("_b0"), F.expr(f"(_before + _n - 1) div {BLOCK}").alias("_b1")).select("*", stretch("_b0", "_b1"))
    in_spans = span_rows.select("*", stretch("_from", "_to - 1"))
    one = F.struct("_phase", "_from", "_to", "_start", "_period", "_w")
    met = in_parts.join(in_spans, ["_k", "_at"]).where("_from <= _b1 AND _to > _b0").groupBy("_k", "_part").agg(F.collect_set(one).alias("_spans"))
    ranked = parted.withColumn("_rank", F.expr("row_number() OVER (PARTITION BY _k, _part ORDER BY shiftrightunsigned(_h, 1), _h)")).join(before.join(met, ["_k", "_part"]), ["_k", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).withColumn("block", F.floor(F.col("_rank") / BLOCK))
    own = F.expr("CASE WHEN size(_spans) = 1 THEN _spans[0] ELSE filter(_spans, s -> s._from <= block AND block < s._to)[0] END")
    placed = ranked.withColumn("_span", own).withColumns({c: F.col("_span").getField(c) for c in ("_phase", "_from", "_start", "_period", "_w")}).withColumn("_i", F.col("block") - F.col("_from")).withColumn("_j", F.col("_i") % F.col("_w"))
    slot_rows = spark.createDataFrame(slots, "_phase int, _k int, _j long, _p long")
    placed = placed.join(F.broadcast(slot_rows) if len(slots) <= SLOTS else slot_rows, ["_phase", "_k", "_j"])
    slot = F.expr("_start + _i div _w * _period + _p")
    return placed.select(
        *[F.col(n).alias(c) for c, n in held_as.items()],
        "block",
        slot.alias("slot"),
        F.expr("_start + _i * _period div _w").alias("release"),
        F.expr("_start + ((_i + 1) * _period + _w - 1) div _w").alias("due"),
        (slot * BLOCK + F.col("_rank") % BLOCK).alias("place"),
    )
