"""Spelling variants: words one edit apart, found by two-dimensional range reporting, and the form that each is a variant of.

A word that replaces, or lacks, the code point at place i of a word x shares with x all that stands before i and all that
stands after.  So in a class of equally long words, sorted forward and sorted by their reversals, every such x lies where the
prefix's interval of the one order meets the suffix's interval of the other.  A wavelet tree over the backward ranks in forward
order reports these meetings for all words and places of a block at once.

The classes are dealt to tasks in blocks: x's places are cut into two halves, and for each half a block holds the words
that agree outside of it.  Each word meets as a query, and as a point, the two halves of its own length's class, and as a query those of
the length above.  A block of more rows than ``limit`` is cut again by halving its places; with one place left a block
has as many rows as there are letters.  Thus a task's tree is bounded, no pair is lost, and every pair is
found once: of the places where an inserted letter may stand in a run of the same letter only the first counts.

Defined results: null texts have no words; A-Z are lower-cased and no other letters; equal numbers of occurrences are told
apart by code-point order; a word near to none has n_near 0 and null forms and is its own root; repeated rows count
again; an empty table gives an empty table; other columns of the documents are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import cut, give_back, slices, stored_at

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Distinct words that a worker counts before it hands them on.
HELD = 100_000
#: Rows of a block; a task builds trees over fewer than twice as many rows, or about twice as many bytes of words.
LIMIT, BYTES = 20_000, 16_000_000
#: Blocks that are cut again are fewer than this, as each has more than one in so many of all rows.
CUT_AT_ONCE = 100_000
FOUND = "word string, n_near long, form_n long, form string"


def slipped(doc: str, run: str) -> str:
    """The run without one code point, for one in 31 of the pairs of document and run."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % 31:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(df: DataFrame, text: str = "text", doc: str = "doc_id", least_chars: int = 7, least_count: int = 2, slips: bool = True) -> DataFrame:
    """(word, n): runs of letters of all documents, and how often they occur.  slips: with the slips of ``slipped``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                for key, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    # a run that is too short can't become a word
                    for found, n in Counter(RUN.findall(body.translate(LOWER))).items():
                        if len(found) >= least_chars:
                            word = slipped(key, found) if slips else found
                            if len(word) >= least_chars:
                                held[word] += n
                    if len(held) >= HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()
        give_back()

    docs = df.select(F.coalesce(F.col(doc).cast("string"), F.lit("")).alias("key"), F.col(text).alias("body")).where("body IS NOT NULL")
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of (size, a, b, word, ...) with the hash of what stands outside of the places a to b."""
    return rows.withColumn("key", F.expr("xxhash64(size, a, b, left(word, a), right(word, size - b))"))


def blocks(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(size, a, b, key, word, n, point): the words of each block; point: the word is of the block's size, else one letter shorter."""
    halves = "array(struct({0} AS size, 0 AS a, {0} div 2 AS b, {1} AS point), struct({0} AS size, {0} div 2 AS a, {0} AS b, {1} AS point))"
    of = f"concat({halves.format('CAST(length(word) AS INT)', 'true')}, {halves.format('CAST(length(word) + 1 AS INT)', 'false')})"
    rows = words.select("word", "n", F.explode(F.expr(of)).alias("x")).select("word", "n", F.col("x.size").alias("size"), F.col("x.a").cast("int").alias("a"), F.col("x.b").cast("int").alias("b"), "x.point")
    done: DataFrame | None = None
    while True:
        rows, _ = stored_at(_keyed(rows))
        counted, _ = stored_at(rows.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("b") - F.col("a")).alias("places")))
        least = F.greatest(F.lit(limit), F.expr(f"coalesce(sum(rows), 0) div {CUT_AT_ONCE}"))
        full = counted.join(F.broadcast(counted.agg(least.alias("least"))), (F.col("rows") > F.col("least")) & (F.col("places") > 1)).select("key")
        if full.isEmpty():
            return rows if done is None else done.unionByName(rows)
        # fewer than CUT_AT_ONCE keys
        fits = rows.join(F.broadcast(full), "key", "left_anti")
        done = fits if done is None else done.unionByName(fits)
        middle = F.expr("(a + b) div 2").cast("int")
        two = F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))
        rows = rows.join(F.broadcast(full), "key", "left_semi").select("word", "n", "size", "point", F.explode(two).alias("y")).select("word", "n", "size", "y.a", "y.b", "point")


class Wavelet:
    """A wavelet matrix over a permutation; reports, for many rectangles at once, the values that lie in them."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for k in reversed(range(self.bits)):
            bit = (values >> k) & 1
            ones = np.zeros(len(values) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - ones[-1])
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which rectangle, value) of each value in [least, most) at a place in [low, high)."""
        which, node = np.arange(len(low)), np.zeros(len(low), np.int64)
        for k in range(self.bits):
            half = 1 << (self.bits - 1 - k)
            l1, h1 = self.ones[k][low], self.ones[k][high]
            l0, h0 = low - l1, high - h1
            left = (h0 > l0) & (node < most[which]) & (node + half > least[which])
            right = (h1 > l1) & (node + half < most[which]) & (node + 2 * half > least[which])
            z = self.zeros[k]
            low, high = np.concatenate([l0[left], l1[right] + z]), np.concatenate([h0[left], h1[right] + z])
            which, node = np.concatenate([which[left], which[right]]), np.concatenate([node[left], node[right] + half])
        return which, node


def _table(words: list[bytes], size: int) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), size)


def _heads(table: np.ndarray, size: int) -> np.ndarray:
    return np.ascontiguousarray(table[:, :size]).view(f"S{size}").ravel()


def _interval(order: np.ndarray, asked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where in the sorted table ``order`` the rows with the first ``size`` bytes of each asked row are."""
    if size == 0:
        return np.zeros(len(asked), np.int64), np.full(len(asked), len(order), np.int64)
    held, wanted = _heads(order, size), _heads(asked, size)
    return np.searchsorted(held, wanted, "left"), np.searchsorted(held, wanted, "right")


def near(words: list[bytes], points: np.ndarray, size: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (word, near word) of all pairs with their one edit at a place from a to b of the longer, or either, word.

    words: distinct for each value of ``points``, all ``size`` long where that is true, else one letter shorter.
    """
    own, short = np.flatnonzero(points), np.flatnonzero(~points)
    if not len(own):
        return own, own
    table = _table([words[i] for i in own], size)
    forward = np.argsort(_heads(table, size))
    back = np.ascontiguousarray(table[:, ::-1])
    backward = np.argsort(_heads(back, size))
    rank = np.empty(len(own), np.int64)
    rank[backward] = np.arange(len(own))
    tree, ahead, behind = Wavelet(rank[forward]), table[forward], back[backward]
    asked = [(table, back, own, 1)]
    if len(short):
        less = _table([words[i] for i in short], size - 1)
        asked.append((less, np.ascontiguousarray(less[:, ::-1]), short, 0))
    sources, targets = [], []
    for i in range(a, b):
        for rows, reverse, index, itself in asked:
            low, high = _interval(ahead, rows, i)
            some = np.flatnonzero(high - low > itself)
            least, most = _interval(behind, reverse[some], size - 1 - i)
            both = most - least > itself
            some, least, most = some[both], least[both], most[both]
            which, value = tree.report(low[some], high[some], least, most)
            query, point = some[which], backward[value]
            if itself:
                other = query != point
                sources.append(own[query[other]])
                targets.append(own[point[other]])
            else:
                # in a run of the inserted letter only its first place counts
                first = table[point, i - 1] != table[point, i] if i else np.ones(len(point), bool)
                long, bare = own[point[first]], index[query[first]]
                sources += [bare, long]
                targets += [long, bare]
    return np.concatenate(sources), np.concatenate(targets)


def _settled(words: list[str], n: np.ndarray, points: np.ndarray, size: int, a: int, b: int) -> pa.RecordBatch:
    """Of each word with near ones in this block: how many, and the best of them."""
    source, target = near([w.encode("latin-1") for w in words], points, size, a, b)
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[target], -n[target], source))
    source, target = source[order], target[order]
    start = np.flatnonzero(np.r_[True, source[1:] != source[:-1]]) if len(source) else np.zeros(0, np.int64)
    count = np.diff(np.r_[start, len(source)])
    best = target[start]
    names = pa.array(words, pa.string())
    return pa.RecordBatch.from_arrays([names.take(pa.array(source[start])), pa.array(count, pa.int64()), pa.array(n[best], pa.int64()), names.take(pa.array(best))], names=["word", "n_near", "form_n", "form"])


def _blocks_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (size, a, b, key), cut between blocks into parts of one (size, a, b) and about LIMIT rows."""
    held: list[pa.Table] = []

    def parts(table: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        table = table.combine_chunks()
        size, a, b, key = (table.column(c).to_numpy() for c in ("size", "a", "b", "key"))
        turn = np.flatnonzero((np.diff(key) != 0) | (np.diff(size) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        ends = np.r_[turn, len(key)] if last else turn
        out, start = [], 0
        for i, end in enumerate(ends):
            after = ends[i + 1] if i + 1 < len(ends) else end
            other = end < len(key) and (size[end], a[end], b[end]) != (size[start], a[start], b[start])
            if other or (last and end == len(key)) or end - start >= LIMIT or (end - start) * int(size[start]) > BYTES or (after > end and after - start > 2 * LIMIT):
                out.append(table.slice(start, end - start))
                start = int(end)
        return out, table.slice(start)

    waiting = 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            waiting += batch.num_rows
        if waiting >= LIMIT:
            done, rest = parts(pa.concat_tables(held), False)
            yield from done
            held, waiting = [rest], 0
    if held:
        done, _ = parts(pa.concat_tables(held), True)
        yield from done


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _blocks_in_order(batches):
        if part.num_rows:
            size, a, b = (part.column(c)[0].as_py() for c in ("size", "a", "b"))
            yield _settled(part.column("word").to_pylist(), part.column("n").to_numpy(), part.column("point").to_numpy(zero_copy_only=False), size, a, b)
    give_back()


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last.  A form is ``ratio`` times as frequent, so chains are short."""
    forms = cut(forms)
    going, done = forms.withColumnRenamed("form", "at"), None
    while True:
        on = forms.withColumnsRenamed({"word": "at", "form": "next"})
        step = cut(going.join(on, "at", "left"))
        ended = step.where("next IS NULL").select("word", F.col("at").alias("root"))
        done = ended if done is None else done.unionByName(ended)
        going = step.where("next IS NOT NULL").select("word", F.col("next").alias("at"))
        if going.isEmpty():
            return done


def variants(words: DataFrame, ratio: int = 10, limit: int = LIMIT) -> DataFrame:
    """(word, n) -> word, n, n_near, form, form_n, root.

    form: the near word with the largest n (of equal ones the least), if that is at least ``ratio`` (2 or more) times n.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2, or forms could lead in circles")
    words, _ = stored_at(words.select("word", "n"))
    order = ["size", "a", "b", "key"]
    dealt = blocks(words, limit).repartitionByRange(*order).sortWithinPartitions(*order)
    found = dealt.select(*order, "word", "n", "point").mapInArrow(_found, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    each = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    far = -F.col("best.less") >= ratio * F.col("n")
    met = words.join(each, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("best.form")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n"))
    met, _ = stored_at(met)
    last = roots(met.where("form IS NOT NULL").select("word", "form"))
    return met.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
