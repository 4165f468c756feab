"""A bounded sample of labelled documents for the classifiers, and their folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import cut

#: Bytes of labelled texts that training reads at most.
BYTES = 48_000_000


def fold(doc_id: str = "doc_id"):
    """0, 1 or 2: crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, doc_id: str = "doc_id", text: str = "text", size: int = BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``bound`` labelled documents outside fold 1, the first by a hash of the id.

    Ids that are null, unlabelled or labelled both ways are left out, as are null texts; a repeated id gives the text
    that sorts first.  A document that would bring the texts above ``size`` bytes is passed over.  So at most ``bound``
    ids are broadcast, and at most ``bound`` whole texts of ``size`` bytes reach the driver, whatever repeats.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).where(fold(doc_id) != 1)
    chosen = known.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z")
    order = F.xxhash64(F.col("_id").cast("string"))
    chosen = chosen.orderBy(order, "_id").limit(bound).select("_id", "_y")
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).where(F.col("_t").isNotNull()).join(F.broadcast(chosen), "_id")
    found = cut(found.groupBy("_id", "_y").agg(F.min("_t").alias("_t")))
    sizes = found.select("_id", F.octet_length("_t").alias("_n"), order.alias("_o")).orderBy("_o", "_id").collect()
    fits, left = [], size
    for r in sizes:
        if r["_n"] <= left:
            fits.append(r["_id"])
            left -= r["_n"]
    if len(fits) < len(sizes):
        kept = found.sparkSession.createDataFrame([(i,) for i in fits], found.select("_id").schema)
        found = found.join(F.broadcast(kept), "_id", "left_semi")
    rows = sorted(found.collect(), key=lambda r: r["_id"])
    return [r["_t"] for r in rows], [int(r["_y"]) for r in rows]
