"""Connected components of an edge table by hooking to the smallest neighbour and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeweave.llm.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows the pointers to their ends by
    doubling, and contracts the edges; a star needs one round, a path a logarithmic number.  All
    aggregations combine before they shuffle, so the centre of a large star is no hot key, and the
    joins are plain equi-joins whose large keys the engine can split.  Lineage is cut every round.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        point = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        while True:
            up = point.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            moved = cut(point.join(up, "root").select("node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")))
            point = moved.drop("moved")
            if moved.where("moved").isEmpty():
                break
        if labels is None:
            labels = point
        else:
            step = point.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            labels = cut(labels.join(step, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
        a = point.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = cut(
            edges.join(a, "a").join(b, "b").where("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
