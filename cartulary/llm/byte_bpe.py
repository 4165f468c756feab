"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file (base64 token, rank) is turned into a byte-level BPE model: every byte stands for one printable character,
every way to split a token into two known tokens is a merge of that token's rank, and a match of the split pattern that
is a token itself is taken whole.  Each match of the pattern is encoded on its own; matches are looked up in a bounded
cache, so the model runs once for a frequent word.

Defined results: a null text is the empty text (no tokens, empty bytes); repeated rows are encoded alike; extra columns
pass through, and an output column replaces an input column of the same name; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartulary.llm.common import Memo, memo, per_slice

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where it is printable Latin-1, else one of those from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class ByteBPE:
    """The model of one rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        chars = byte_characters()
        show = {t: "".join([chars[b] for b in t]) for t in ranks}
        merges = [(show[t[:i]], show[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={show[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.find = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)

    def encode(self, texts: list[str], known: Memo | None = None) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; known: those of matches met before, while there is room."""
        get, found, missing = (known or {}).get, [], {}
        for text in texts:
            pieces = self.find(text)
            ids = list(map(get, pieces))
            if None in ids:
                missing.update((p, None) for p, i in zip(pieces, ids, strict=True) if i is None)
            found.append((pieces, ids))
        if missing:
            keys = list(missing)
            for key, got in zip(keys, self.model.encode_batch_fast(keys, add_special_tokens=False), strict=True):
                missing[key] = np.array(got.ids, dtype="<u4").tobytes()
            if known is not None:
                known.learn(missing)
        return [b"".join([missing[p] if i is None else i for p, i in zip(pieces, ids, strict=True)] if missing else ids) for pieces, ids in found]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, by the byte table; a character split between tokens is whole again in them."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])

    def offsets(self, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First character and end (exclusive) of each token; tokens that share a split character share its place."""
        sizes = self.lengths[np.frombuffer(ids, dtype="<u4")]
        end = np.cumsum(sizes)
        lead = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        upto = np.concatenate(([0], np.cumsum(lead)))
        starts = end - sizes
        first = upto[starts] - np.where(lead[np.minimum(starts, max(len(lead) - 1, 0))], 0, 1) if len(lead) else upto[starts]
        return first.astype(np.int32), upto[end].astype(np.int32)


def _known(path: str, pattern: str) -> Memo:
    """The worker's memo of matches for this rank file, with the model, which is built once."""
    held = memo(__name__, path, pattern)
    if held.model is None:
        held.model = ByteBPE(path, pattern)
    return held


def model(path: str, pattern: str) -> ByteBPE:
    return _known(path, pattern).model


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    keep = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in new]
    return pa.RecordBatch.from_arrays([c for _, c in keep] + list(new.values()), names=[n for n, _ in keep] + list(new))


def _schema(df: DataFrame, new: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {n for n, _ in new}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + [T.StructField(n, t) for n, t in new])


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """Add ``ids`` (little-endian 32-bit integers) and ``n_tokens``.

    offsets: also ``starts`` and ``ends`` of the tokens in characters; decoded: also what decoding the ids gives, in the
    same pass, so that one worker holds one model.
    """
    new = [("ids", T.BinaryType()), ("n_tokens", T.LongType())] + [(n, T.ArrayType(T.IntegerType())) for n in ("starts", "ends")] * offsets
    new += [("decoded", T.BinaryType())] * decoded

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = _known(vocabulary, pattern)
        bpe = known.model
        texts = [x or "" for x in batch.column(batch.schema.names.index(text)).to_pylist()]
        ids = bpe.encode(texts, known)
        out = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
        if offsets:
            pairs = [bpe.offsets(i, t.encode()) for i, t in zip(ids, texts, strict=True)]
            out |= {n: pa.array([p[k] for p in pairs], pa.list_(pa.int32())) for k, n in enumerate(("starts", "ends"))}
        if decoded:
            out["decoded"] = pa.array(map(bpe.decode, ids), pa.binary())
        return _with(batch, out)

    return df.mapInArrow(per_slice(run, df.columns.index(text)), _schema(df, new))


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``; a null is decoded as no tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = model(vocabulary, pattern)
        return _with(batch, {"decoded": pa.array([bpe.decode(x or b"") for x in batch.column(batch.schema.names.index(ids)).to_pylist()], pa.binary())})

    return df.mapInArrow(per_slice(run, df.columns.index(ids), 8_000_000), _schema(df, [("decoded", T.BinaryType())]))


def decoded_text(decoded: str = "decoded"):
    """The decoded bytes as text; ill-formed bytes, as a cut list of ids may end in, become U+FFFD."""
    return F.decode(F.col(decoded), "UTF-8")
