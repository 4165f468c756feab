"""Connected components of an undirected graph given as rows of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.common import cut


def _joined_to_smallest(edges: DataFrame, keep) -> DataFrame:
    """Each node's neighbours that ``keep`` names, with the smallest of the node and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").where(keep).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) -> (id, component) of every node that has an edge; component: the smallest id reachable.

    Nulls and loops are no edges; repeated edges count once.  Every round cuts its lineage in the shared folder; the rounds
    end when every edge leads to a node that has none but edges to it, and only the count of other nodes comes to the driver.
    """
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    wrong = 1
    while wrong:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined_to_smallest(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = _joined_to_smallest(large, F.lit(True))
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(near.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("to")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("to")))).alias("e")).select("e.*")
        wrong = ends.groupBy("id").agg(F.sum("up").alias("up"), F.sum("to").alias("to")).where("up > 1 OR (up > 0 AND to > 0)").agg(F.count("*")).first()[0]
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
