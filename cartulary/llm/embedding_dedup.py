"""Near duplicates among embeddings: sign hashing by random hyperplanes, exact cosines, connected components.

Vectors of one label are compared.  Each of several tables hashes a vector to the signs of its products with random
hyperplanes; vectors that share a table's signature are verified by cosine in double precision, so the operator links
what the tables bring together and nothing below the limit.  Signatures have more bits, and there are more tables, where a
label has more vectors: a bucket holds about as many unrelated ones however many there are.  Bit for bit equal vectors of one label stand for each other,
by a count.  A bucket is cut into blocks and compared block by block in matrix products; a pair counts in the first table
that brings it together, so links are counted without writing pairs, and of the links only some go on to the components:
each vector's with the smallest one that it reaches within the blocks compared.

Defined results: null, zero, non-finite or partly null vectors and those with a null label link with nothing; vectors of
unlike lengths have no cosine and do not link; rows of one id are one vector, their first by value counting; a null id
takes no part (no links, component null, kept); extra columns pass through, output columns replace input columns of the
same name; an empty table gives an empty table.
"""

from __future__ import annotations

from math import acos, ceil, log, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import cut, fresh, join_hot
from cartulary.llm.components import components

LIMIT = 0.93
#: Bits of a signature, the fewest that leave about BLOCK unrelated vectors of a label in a bucket; tables follow from them: a pair at the limit shares a table's
#: signature with a probability of (1 - acos(LIMIT) / pi) ** bits, and misses all tables with one of MISSED.
LEVELS, MISSED, SEED, BLOCK = (8, 12, 16, 20, 24), 1e-7, 3, 1024
#: Rows that one call compares, a few blocks: buckets are dealt to so many calls.
DEAL = 20_000


def tables(bits: int) -> int:
    shared = (1 - acos(LIMIT) / pi) ** bits
    return ceil(log(MISSED) / log(1 - shared))


def planes(width: int, bits: int) -> np.ndarray:
    return np.random.default_rng((SEED, width, bits)).normal(size=(width, tables(bits) * bits))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Largest component 1, so that no square overflows or vanishes; a scale leaves signs and cosines as they are."""
    # twice: the inverse of a subnormal number is not finite
    vectors = vectors * np.where(np.abs(vectors).max(axis=1, keepdims=True) < 1e-290, 1e290, 1.0)
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def hashed(df: DataFrame) -> DataFrame:
    """(node, label, vector, bits) -> (node, label, width, bits, vector, codes): doubles, and a signature for each table, as bytes."""

    def run(batches):
        for batch in batches:
            lists, bits = [np.array(x, dtype=np.float64) for x in batch.column(2).to_pylist()], batch.column(3).to_pylist()
            codes: list[bytes] = [b""] * len(lists)
            for width, b in {(len(x), b) for x, b in zip(lists, bits, strict=True)}:
                where = [i for i, x in enumerate(lists) if (len(x), bits[i]) == (width, b)]
                normals = planes(width, b)
                for s in range(0, len(where), BLOCK):
                    part = where[s : s + BLOCK]
                    signs = _scaled(np.array([lists[i] for i in part])) @ normals > 0
                    got = signs.reshape(len(part), tables(b), b) @ (1 << np.arange(b))
                    for i, g in zip(part, got.astype(f"<u{_wide(b)}"), strict=True):
                        codes[i] = g.tobytes()
            # what single precision holds exactly travels in it
            with np.errstate(over="ignore"):
                packed = [(x.astype("<f4") if (x.astype("<f4") == x).all() else x).tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, lists)), pa.int32()), pa.array(bits, pa.int32()), pa.array(packed, pa.binary()), pa.array(codes, pa.binary())], names=["node", "label", "width", "bits", "vector", "codes"])

    return df.mapInArrow(run, "node long, label string, width int, bits int, vector binary, codes binary")


def _wide(bits: int) -> int:
    """Bytes of a signature."""
    return 1 if bits <= 8 else 4


def _unpacked(data: list[bytes], width: int) -> np.ndarray:
    return np.array([np.frombuffer(x, dtype="<f8" if len(x) == 8 * width else "<f4") for x in data], dtype=np.float64)


def _reached(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n nodes that each reaches by the links a - b."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        new = new[new]
        if (new == least).all():
            return least
        least = new


def _linked(table: pa.Table) -> pa.Table:
    """Some pairs of blocks -> (u, v, n): links counted at u; v: the smallest vector that u reaches in that pair of blocks."""
    names = ("label", "width", "bits", "t", "code", "l", "r")
    columns = {c: table[c].to_pylist() for c in (*names, "vector", "codes")} | {c: table[c].to_numpy(zero_copy_only=False) for c in ("node", "right", "many")}
    groups: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(*[columns[c] for c in names], strict=True)):
        groups.setdefault(key, []).append(k)
    out = ([], [], [])
    for (_, width, bits, t, *_), where in groups.items():
        right = columns["right"][where]
        node, many = columns["node"][where], columns["many"][where]
        vectors = _unit(_unpacked([columns["vector"][k] for k in where], width))
        codes = np.frombuffer(b"".join([columns["codes"][k] for k in where]), dtype=f"<u{_wide(bits)}").reshape(len(where), -1)
        i, j = np.flatnonzero(~right), np.flatnonzero(right)
        a, b = np.nonzero(vectors[i] @ vectors[j].T >= LIMIT)
        a, b = i[a], j[b]
        sound = (node[a] != node[b]) & (codes[a, :t] != codes[b, :t]).all(axis=1)
        a, b = a[sound], b[sound]
        if len(a):
            ids, at = np.unique(np.concatenate((node[a], node[b])), return_inverse=True)
            left, other = at[: len(a)], at[len(a) :]
            count = np.bincount(left, many[b], minlength=len(ids)).astype(np.int64)
            for column, x in zip(out, (ids, ids[_reached(left, other, len(ids))], count), strict=True):
                column.append(x)
    return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip("uvn", out, strict=True)})


def classes(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Every row of ``df`` with ``n_links``, ``component_id`` and ``kept``."""
    # -0.0 is 0.0
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.transform(embedding, lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    # nothing but finite numbers, not all zero
    sound = "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)"
    rows = rows.where(sound).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.*")
    # equal vectors meet by two hashes, counted before they are shuffled, so a hot one is a row of each task
    rows = cut(rows.withColumns({"h": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(SEED), F.reverse("vector"))}))
    same = cut(rows.groupBy("label", "h", "h2").agg(F.min("id").alias("node"), F.count("*").alias("many")))
    total = same.agg(F.sum("many")).first()[0] or 0
    copies = cut(join_hot(rows.select("id", "label", "h", "h2"), same, ["label", "h", "h2"], total).select("id", "node", "many"))
    sizes = same.groupBy("label").agg(F.count("*").alias("size"))
    steps = F.lit(LEVELS[-1])
    for b in reversed(LEVELS[:-1]):
        steps = F.when(F.col("size") <= BLOCK << b, b).otherwise(steps)
    leaders = copies.where("id = node").select("id", F.col("many"))
    nodes = rows.join(leaders, "id").join(sizes, "label").select(F.col("id").alias("node"), "label", "vector", steps.cast("int").alias("bits"), "many")
    nodes = cut(hashed(nodes.select("node", "label", "vector", "bits")).join(leaders.withColumnRenamed("id", "node"), "node"))
    many = F.create_map(*[F.lit(x) for b in LEVELS for x in (b, tables(b))])[F.col("bits")]
    wide = F.when(F.col("bits") <= 8, 1).otherwise(4)
    short = F.expr("transform(sequence(0, _tables - 1), t -> struct(t AS t, substring(codes, t * _wide + 1, _wide) AS code))")
    keyed = nodes.withColumns({"_tables": many, "_wide": wide}).select("node", "label", "width", "bits", F.explode(short).alias("k")).select("node", "label", "width", "bits", "k.*")
    shared = cut(keyed.groupBy("label", "width", "bits", "t", "code").agg(F.count("*").alias("size")).where("size > 1"))
    # every block of a bucket meets every other: a row goes once to each of its bucket's blocks on either side
    rows_in_all, in_buckets = shared.agg(F.sum(F.col("size") * F.ceil(F.col("size") / BLOCK) * 2), F.sum("size")).first()
    rows_in_all = rows_in_all or 0
    placed = join_hot(keyed, shared, ["label", "width", "bits", "t", "code"], in_buckets or 0, "size")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    sides = placed.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    key = ("label", "width", "bits", "t", "code", "l", "r")
    tasks = sides.withColumnsRenamed({"own": "l", "other": "r"}).select("node", *key, F.lit(False).alias("right")).unionByName(
        sides.withColumnsRenamed({"own": "r", "other": "l"}).select("node", *key, F.lit(True).alias("right"))
    )
    full = tasks.join(nodes.drop("label", "width", "bits"), "node").withColumn("deal", F.pmod(F.xxhash64(*key), F.lit(rows_in_all // DEAL + 1)))
    links = cut(full.groupBy("deal").applyInArrow(_linked, "u long, v long, n long"))
    roots = components(links.select("u", "v"))
    counts = links.groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    rest = [c for c in df.columns if c not in ("n_links", "component_id", "kept")]
    own, other, n, c = fresh(df.select(*rest), "own", "other", "n", "c")
    found = copies.join(counts, "node", "left").join(roots, copies.node == roots.id, "left").select(copies.id.alias(other), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias(n), F.coalesce("component", "node").alias(c))
    out = df.select(*rest, F.col(vec_id).cast("long").alias(own)).join(found, F.col(own) == F.col(other), "left")
    component = F.coalesce(c, own)
    return out.select(*rest, F.coalesce(n, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col(own), F.lit(True)).alias("kept"))
