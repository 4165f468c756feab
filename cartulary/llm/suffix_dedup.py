"""Removal of byte strings that occurred before, by difference-cover suffix sorting.

What is wanted of each 100-byte window is whether it also starts earlier.  Equal windows have equal content, so each window
is dealt by its anchor, the run of bytes inside it whose hash is smallest: equal windows choose the same one at the same
place.  An anchor that occurs once in the corpus has no repeated window.  The windows that share an anchor occurrence are
one slice of text; of equal slices all but the first are repeats as a whole, and an anchor whose slices are all equal needs
no more.  What is left, the slices in which texts that share an anchor differ, is sorted by the difference cover {1, 2}
modulo 3: sampled triples are sorted and named, the names recurse until they tell 100 bytes apart, the remaining suffixes
are merged in, and neighbours in that order are compared over 100 bytes.  Slices of one anchor meet in one task, so its
sort is local to some megabytes; text moves once, dealt by document.

Defined results: a null text is the empty text; an empty text has no spans and the digest of no bytes; rows alike in id and
text are one document and get equal results; rows of one id and unlike texts are documents of that id in the order of a
64-bit hash of their texts; a null id comes before all others; texts of any length are read whole; extra columns pass through,
output columns replace input columns of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cartulary.llm.common import per_slice

#: Bytes of a window, and of the run in it that anchors it.
WINDOW, RUN = 100, 32
#: Bytes of text whose anchors are found at once, that one group of documents holds about, and that one sort holds about.
SLICE, SHARD, SORT = 2_000_000, 16_000_000, 1_500_000
_M24 = np.uint64((1 << 24) - 1)
_ODD = 0x9E3779B97F4A7C15
_NULL = -(1 << 63)
#: Bytes as numbers, for the two hashes that slices are told apart by.
_TABLE, _TABLE2 = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64), np.random.default_rng(18).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(21, int(n - 1).bit_length())
        _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.full(size - 1, x, dtype=np.uint64))).cumprod(dtype=np.uint64) for x in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


FIELDS = {
    "anchor": (("g", "<u8"), ("c", "<u8"), ("c2", "<u8"), ("d", "<i8"), ("th", "<i8"), ("p", "<u4"), ("a", "u1"), ("b", "u1")),
    "span": (("d", "<i8"), ("th", "<i8"), ("s", "<u4"), ("e", "<u4")),
    "open": (("g", "<u8"), ("d", "<i8"), ("th", "<i8"), ("s", "<u4"), ("e", "<u4")),
}


def pack(kind: str, rows: dict[str, np.ndarray], extra: bytes = b"") -> bytes:
    """Columns as one compressed string: how many rows, then column after column, then the rest."""
    n = len(next(iter(rows.values())))
    body = b"".join([np.ascontiguousarray(rows[f], dtype=t).tobytes() for f, t in FIELDS[kind]])
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(body + extra)


def unpack(kind: str, blobs: list[bytes]) -> tuple[dict[str, np.ndarray], bytes]:
    parts: dict[str, list[np.ndarray]] = {f: [np.zeros(0, dtype=t)] for f, t in FIELDS[kind]}
    extra = []
    for blob in blobs:
        n, body, at = int.from_bytes(blob[:8], "little"), zstandard.ZstdDecompressor().decompress(blob[8:]), 0
        for f, t in FIELDS[kind]:
            parts[f].append(np.frombuffer(body, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
        extra.append(body[at:])
    return {f: np.concatenate(x) for f, x in parts.items()}, b"".join(extra)


def anchors(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Of every maximal row of windows with one anchor: text (t), anchor place (p), first and last window (p - a, p - b), hashes.

    Windows of a text longer than the 24 bits that hold a place are cut into overlapping stretches by the caller.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n, sizes = len(data), np.array([len(t) for t in texts], dtype=np.int64)
    if n < WINDOW:
        return {k: np.zeros(0, dtype=np.int64) for k in ("t", "p", "a", "b", "g", "c", "c2")}
    up, down = powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), (_TABLE[data] * up).cumsum(dtype=np.uint64)))
        h = mix((sums[RUN:] - sums[:-RUN]) * down[: n - RUN + 1])
    least = (h & ~_M24) | np.arange(len(h), dtype=np.uint64)
    width, wanted = 1, WINDOW - RUN + 1
    while width < wanted:
        step = min(width, wanted - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    i = np.flatnonzero(np.arange(len(least)) + WINDOW <= (first + sizes)[owner])
    at = (least[i] & _M24).astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (i[1:] != i[:-1] + 1)))) if len(i) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(i)) - 1 if len(begin) else begin
    lo, hi, p = i[begin], i[end], at[begin]
    with np.errstate(over="ignore"):
        c = mix((sums[hi + WINDOW] - sums[lo]) * down[lo] + mix((p - lo).astype(np.uint64)))
        sums[1:] = (_TABLE2[data] * up).cumsum(dtype=np.uint64)
        c2 = mix((sums[hi + WINDOW] - sums[lo]) * down[lo])
    t = owner[lo]
    return {"t": t, "p": p - first[t], "a": p - lo, "b": p - hi, "g": h[p], "c": c, "c2": c2}


def shard_of(ids: np.ndarray, hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where a document is dealt: by its id and its text's hash, so that neither null ids nor copies of one text meet in one shard only."""
    return (ids.astype(np.int64) ^ hashes.astype(np.int64)) % shards


def _dealt(kind: str, rows: dict[str, np.ndarray], where: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(where, kind="stable")
    keys, first = np.unique(where[order], return_index=True)
    ends = np.append(first[1:], len(order))[: len(first)]
    return [(int(k), pack(kind, {f: x[order[s:e]] for f, x in rows.items()})) for k, s, e in zip(keys, first, ends, strict=True)]


def _table(key: str, rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({key: pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _find_anchors(shards: int):
    """(d, text) -> (bucket, kind, blob): anchors (0), and slices that occurred before within these very texts (1)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = sorted(set(_texts(batch.column(0), batch.column(1))))
        found: list[dict[str, np.ndarray]] = []
        reach = (1 << 23) - WINDOW + 1  # stretches of a long text share WINDOW - 1 bytes, so each window is in one of them
        pieces = [(d, th, s, t[s : s + reach + WINDOW - 1]) for d, th, t in rows for s in range(0, max(1, len(t) - WINDOW + 1), reach)]
        k = 0
        while k < len(pieces):
            e, size = k, 0
            while e < len(pieces) and (e == k or size + len(pieces[e][3]) <= SLICE):
                size += len(pieces[e][3])
                e += 1
            got = anchors([x[3] for x in pieces[k:e]])
            t = got.pop("t")
            for name, j, kind in (("d", 0, np.int64), ("th", 1, np.int64), ("s", 2, np.int64)):
                got[name] = np.array([x[j] for x in pieces[k:e]], dtype=kind)[t]
            got["p"] = got["p"] + got.pop("s")
            found.append(got)
            k = e
        all_ = {f: np.concatenate([x[f] for x in found]) for f in found[0]}
        with np.errstate(over="ignore"):
            both = mix(all_["g"]) + all_["c"] * np.uint64(_ODD)
        order = np.lexsort((all_["c2"], both))  # stable, and texts are in the order of ids, so the first is the earliest
        new = np.zeros(len(both), dtype=bool)
        new[order] = np.concatenate(([True], (both[order][1:] != both[order][:-1]) | (all_["c2"][order][1:] != all_["c2"][order][:-1]))) if len(order) else new
        some = {f: x[new] for f, x in all_.items()}
        out = [(k, 0, b) for k, b in _dealt("anchor", some, (some["g"] % np.uint64(shards)).astype(np.int64))]
        old = {f: x[~new] for f, x in all_.items()}
        spans = {"d": old["d"], "th": old["th"], "s": old["p"] - old["a"], "e": old["p"] - old["b"] + WINDOW}
        out += [(k, 1, b) for k, b in _dealt("span", spans, (old["g"] % np.uint64(shards)).astype(np.int64))]
        return pa.RecordBatch.from_struct_array(_table("bucket", out).to_struct_array().combine_chunks())

    return per_slice(run, 1, 4 * SLICE)


def _compare_slices(shards: int):
    """The anchors of one bucket -> (shard, kind, blob): slices that repeat as a whole (1), and those still open (2)."""

    def run(table: pa.Table) -> pa.Table:
        kind, blobs = table["kind"].to_pylist(), table["blob"].to_pylist()
        x, _ = unpack("anchor", [b for k, b in zip(kind, blobs, strict=True) if k == 0])
        known, _ = unpack("span", [b for k, b in zip(kind, blobs, strict=True) if k == 1])
        g = np.sort(x["g"])
        often = np.unique(g[1:][g[1:] == g[:-1]])
        some = np.flatnonzero(np.isin(x["g"], often)) if len(often) else np.zeros(0, np.int64)
        x = {f: v[some] for f, v in x.items()}
        order = np.lexsort((x["p"], x["th"], x["d"], x["c2"], x["c"], x["g"]))
        x = {f: v[order] for f, v in x.items()}
        # rows alike in id and text that different batches read are one document: their slices count once
        alike = np.zeros(len(order), dtype=bool)
        alike[1:] = np.logical_and.reduce([x[f][1:] == x[f][:-1] for f in ("g", "c", "c2", "d", "th", "p")])
        x = {f: v[~alike] for f, v in x.items()}
        c, c2 = x["c"], x["c2"]
        new_g = np.concatenate(([True], x["g"][1:] != x["g"][:-1])) if len(c) else np.zeros(0, bool)
        first = np.concatenate(([True], (c[1:] != c[:-1]) | (c2[1:] != c2[:-1]))) | new_g if len(c) else new_g
        slices = np.bincount(np.cumsum(new_g)[first] - 1, minlength=int(new_g.sum())) if len(c) else np.zeros(0, np.int64)
        mixed = slices[np.cumsum(new_g) - 1] > 1 if len(c) else new_g
        lo, hi = x["p"].astype(np.int64) - x["a"], x["p"].astype(np.int64) - x["b"] + WINDOW
        spans = {f: np.concatenate((known[f], v[~first])) for f, v in {"d": x["d"], "th": x["th"], "s": lo, "e": hi}.items()}
        left = {f: v[first & mixed] for f, v in {"g": x["g"], "d": x["d"], "th": x["th"], "s": lo, "e": hi}.items()}
        out = [(k, 1, b) for k, b in _dealt("span", spans, shard_of(spans["d"], spans["th"], shards))] + [(k, 2, b) for k, b in _dealt("open", left, shard_of(left["d"], left["th"], shards))]
        return _table("shard", out)

    return run


def _texts(ids, texts) -> list[tuple[int, int, bytes]]:
    """(id, hash of the text, its bytes) of rows: the hash that Spark's xxhash64 gives; a null id comes before all others."""
    data = [(x or "").encode("utf-8", "replace") for x in texts.to_pylist()]
    hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in data], dtype=np.uint64).view(np.int64).tolist()
    return [(_NULL if d is None else d, h, t) for d, h, t in zip(ids.to_pylist(), hashes, data, strict=True)]


def _read_slices(shards: int):
    """The documents of a shard and their open slices -> (bucket, kind, blob), with the slices' bytes."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        blobs = [b for k, b in zip(found["kind"].to_pylist(), found["blob"].to_pylist(), strict=True) if k == 2]
        x, _ = unpack("open", blobs)
        texts = {(d, th): t for d, th, t in _texts(docs["d"], docs["text"])}
        bucket = (x["g"] % np.uint64(shards)).astype(np.int64)
        order, out = np.argsort(bucket, kind="stable"), []
        keys, first = np.unique(bucket[order], return_index=True)
        for k, s, e in zip(keys, first, np.append(first[1:], len(order))[: len(first)], strict=True):
            rows = {f: v[order[s:e]] for f, v in x.items()}
            data = b"".join([texts[d, th][a:b] for d, th, a, b in zip(*(rows[f].tolist() for f in ("d", "th", "s", "e")), strict=True)])
            out.append((int(k), 0, pack("open", rows, data)))
        return _table("bucket", out)

    return run


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The rank of each key among the distinct keys, from 1, and how many there are."""
    if len(keys) and int(keys.max()) < 1 << 25:
        seen = np.zeros(int(keys.max()) + 1, dtype=bool)
        seen[keys.astype(np.int64)] = True
        return np.cumsum(seen)[keys.astype(np.int64)].astype(np.uint64), int(seen.sum())
    values, back = np.unique(keys, return_inverse=True)
    return (back + 1).astype(np.uint64), len(values)


def _triple(x: np.ndarray, y: np.ndarray, z: np.ndarray, base: int, last: int) -> np.ndarray:
    """Order-preserving keys of triples; where 64 bits cannot hold them, pairs are named first."""
    if base * base * last < 1 << 64:
        return (x * np.uint64(base) + y) * np.uint64(last) + z
    pair, _ = _names(x * np.uint64(base) + y)
    return pair * np.uint64(last) + z


def suffix_ranks(s: np.ndarray, depth: int = WINDOW, covered: int = 1) -> np.ndarray:
    """Ranks of the suffixes of ``s`` (unsigned, from 1) that tell apart any two that differ within ``depth`` symbols.

    Sampled: places 1 and 2 modulo 3.  Their triples are sorted and named; names recurse while equal ones are left and do
    not cover ``depth``.  A remaining suffix is its first symbol and a sampled one; it is merged by counting those below.
    """
    n = len(s)
    t = np.concatenate((s, np.zeros(4, dtype=np.uint64)))
    base = int(s.max(initial=0)) + 1
    ones, twos, zeros = (np.arange(k, n, 3) for k in (1, 2, 0))
    sampled = np.concatenate((ones, twos))
    name, many = _names(_triple(t[sampled], t[sampled + 1], t[sampled + 2], base, base))
    if many < len(sampled) and 3 * covered < depth:
        # a gap keeps the two rows of names apart: one more name, below all others, ends the first
        row = np.concatenate((name[: len(ones)], np.zeros(1, np.uint64), name[len(ones) :])) + np.uint64(1)
        ranks = suffix_ranks(row, depth, 3 * covered)
        name, many = _names(np.concatenate((ranks[: len(ones)], ranks[len(ones) + 1 :])))
    rank = np.zeros(n + 4, dtype=np.uint64)
    rank[sampled] = name
    last = many + 1
    by_one = lambda i: t[i] * np.uint64(last) + rank[i + 1]
    own, one = by_one(zeros), by_one(ones)
    both = _triple(*(np.concatenate((x[zeros + k], x[twos + k])) for x, k in ((t, 0), (t, 1), (rank, 2))), base, last)
    own2, two = both[: len(zeros)], both[len(zeros) :]
    own_sorted, own2_sorted = np.sort(own), np.sort(own2)
    out = np.empty(n, dtype=np.uint64)
    below = np.concatenate(([0], np.cumsum(np.bincount(name.astype(np.int64), minlength=last))))[name.astype(np.int64)] if len(sampled) else np.zeros(0, np.int64)
    out[zeros] = np.searchsorted(own_sorted, own) + np.searchsorted(np.sort(one), own) + np.searchsorted(np.sort(two), own2)
    out[ones] = below[: len(ones)] + np.searchsorted(own_sorted, one)
    out[twos] = below[len(ones) :] + np.searchsorted(own2_sorted, two)
    return out


def repeated_windows(slices: list[bytes], order: np.ndarray, group: np.ndarray) -> list[tuple[int, int, int]]:
    """(slice, first window, end window) of the windows that also start in an earlier place.

    order: sorts the slices by document and place; group: slices of different groups hold no equal windows.
    """
    data = b"\0".join(slices) + b"\0"
    raw = np.frombuffer(data, dtype=np.uint8)
    sizes = np.array([len(x) for x in slices], dtype=np.int64)
    first = np.cumsum(sizes + 1) - sizes - 1
    symbols = raw.astype(np.uint64) + np.uint64(2)
    symbols[first + sizes] = 1
    ranks = suffix_ranks(symbols)
    windows = sizes - WINDOW + 1
    owner = np.repeat(np.arange(len(slices)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
    # equal ranks may still hide unlike suffixes only beyond the depth, so equal prefixes are neighbours
    seat = np.lexsort((at - first[owner], order[owner], ranks[at]))
    at, owner = at[seat], owner[seat]
    words = np.zeros(len(raw), dtype=np.uint64)
    padded = np.concatenate((raw, np.zeros(8, np.uint8)))
    for k in range(8):
        words = (words << np.uint64(8)) | padded[k : k + len(raw)]
    same = np.ones(max(len(at) - 1, 0), dtype=bool)
    for k in (*range(0, WINDOW - 8, 8), WINDOW - 8):
        live = np.flatnonzero(same)
        same[live] = words[at[live + 1] + k] == words[at[live] + k]
    head = np.concatenate(([True], ~same)) if len(at) else np.zeros(0, bool)
    cls = np.cumsum(head) - 1
    place = order[owner].astype(np.int64) * (1 << 24) + (at - first[owner])
    earliest = np.full(int(cls[-1]) + 1 if len(cls) else 0, np.iinfo(np.int64).max)
    np.minimum.at(earliest, cls, place)
    again = np.sort(at[place > earliest[cls]])
    if not len(again):
        return []
    starts = np.flatnonzero(np.concatenate(([True], again[1:] != again[:-1] + 1)))
    ends = np.append(starts[1:], len(again)) - 1
    which = np.searchsorted(first, again[starts], side="right") - 1
    return [(int(w), int(again[s] - first[w]), int(again[e] - first[w]) + 1) for w, s, e in zip(which, starts, ends, strict=True)]


def _sort_slices(shards: int):
    """The open slices of one bucket -> (shard, kind, blob): spans of their repeated windows (1)."""

    def run(table: pa.Table) -> pa.Table:
        spans: list[tuple[int, int, int, int]] = []
        x, data = unpack("open", table["blob"].to_pylist())
        ends = np.cumsum(x["e"].astype(np.int64) - x["s"])
        begin = ends - (x["e"].astype(np.int64) - x["s"])
        by_group = np.lexsort((x["s"], x["th"], x["d"], x["g"]))
        g, k = x["g"][by_group], 0
        size = np.cumsum((ends - begin)[by_group])
        while k < len(by_group):
            e = int(np.searchsorted(size, (size[k - 1] if k else 0) + SORT, side="right"))
            e = max(e, k + 1)
            while e < len(g) and e > k and g[e] == g[e - 1]:  # whole groups only: back to where one begins, else on to its end
                back = int(np.searchsorted(g[k:e], g[e])) + k
                e = back if back > k else int(np.searchsorted(g, g[e], side="right"))
            part = by_group[k:e]
            slices = [data[s:t] for s, t in zip(begin[part].tolist(), ends[part].tolist(), strict=True)]
            order = np.empty(len(part), dtype=np.int64)
            order[np.lexsort((x["s"][part], x["th"][part], x["d"][part]))] = np.arange(len(part))
            for w, s, t in repeated_windows(slices, order, g[k:e]):
                row = part[w]
                spans.append((int(x["d"][row]), int(x["th"][row]), int(x["s"][row]) + s, int(x["s"][row]) + t - 1 + WINDOW))
            k = e
        rows = {f: np.array([r[j] for r in spans], dtype=t) for j, (f, t) in enumerate(FIELDS["span"])}
        return _table("shard", [(k, 1, b) for k, b in _dealt("span", rows, shard_of(rows["d"], rows["th"], shards))])

    return run


def _remove(docs: pa.Table, found: pa.Table, schema: pa.Schema) -> pa.Table:
    """The documents of a shard without the bytes of their spans; spans that meet or overlap are one."""
    x, _ = unpack("span", [b for k, b in zip(found["kind"].to_pylist(), found["blob"].to_pylist(), strict=True) if k == 1])
    order = np.lexsort((x["s"], x["th"], x["d"]))
    x = {f: v[order].astype(np.int64) for f, v in x.items()}
    key = np.flatnonzero(np.concatenate(([True], (x["d"][1:] != x["d"][:-1]) | (x["th"][1:] != x["th"][:-1])))) if len(order) else np.zeros(0, np.int64)
    where = {(int(x["d"][s]), int(x["th"][s])): (int(s), int(e)) for s, e in zip(key, np.append(key[1:], len(order))[: len(key)], strict=True)}
    columns: tuple[list, ...] = ([], [], [], [], [])
    for d, th, t in _texts(docs["d"], docs["text"]):
        spans: list[list[int]] = []
        s, e = where.get((d, th), (0, 0))
        for a, b in zip(x["s"][s:e].tolist(), x["e"][s:e].tolist(), strict=True):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            else:
                spans.append([a, b])
        left, at = [], 0
        for a, b in spans:
            left.append(t[at:a])
            at = b
        kept = b"".join([*left, t[at:]])
        for column, value in zip(columns, (len(t), len(t) - len(kept), len(spans), kept, [{"start": a, "end": b} for a, b in spans]), strict=True):
            column.append(value)
    out = [docs["row"]] + [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True)]
    return pa.table(out, names=schema.names)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``df`` but its text, with n_bytes, n_removed, n_spans, ``kept`` (the remaining bytes) and ``spans``."""
    new = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept", T.BinaryType())]
    new.append(("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    keep = [c for c in df.columns if c != text and c not in dict(new)]
    # the columns of ``df`` travel in one, so that none meets a name of these plans; it is never empty
    row = F.struct(F.lit(True).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)])
    docs = df.select(row.alias("row"), F.col(doc_id).cast("long").alias("d"), F.col(text).alias("text"))
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = size // SHARD + 1
    docs = docs.withColumn("shard", F.pmod(F.coalesce("d", F.lit(_NULL)).bitwiseXOR(F.xxhash64(F.coalesce("text", F.lit("")))), F.lit(shards)))
    schema = T.StructType([docs.schema["row"], *[T.StructField(n, t) for n, t in new]])
    arrow = to_arrow_schema(schema)
    blob = lambda key: f"{key} long, kind int, blob binary"
    found = docs.select("d", "text").mapInArrow(_find_anchors(shards), blob("bucket"))
    compared = found.groupBy("bucket").applyInArrow(_compare_slices(shards), blob("shard"))
    # the same columns in both cogroups, so that the documents are shuffled once
    read = docs.groupBy("shard").cogroup(compared.groupBy("shard")).applyInArrow(_read_slices(shards), blob("bucket"))
    sorted_ = read.groupBy("bucket").applyInArrow(_sort_slices(shards), blob("shard"))
    both = compared.unionByName(sorted_)

    def finish(rows: pa.Table, spans: pa.Table) -> pa.Table:
        return _remove(rows, spans, arrow)

    done = docs.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(finish, schema)
    return done.select(*[F.col("row").getField(f"c{k}").alias(c) for k, c in enumerate(keep)], *dict(new))
