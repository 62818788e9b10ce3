"""Connected components of an edge table, as Spark joins.

Alternating large-star and small-star steps: every edge is pulled towards the
smallest neighbour until the graph is a set of stars. The number of rounds
grows with the logarithm of the longest path. Minima are hash aggregates with
partial aggregation and the joins are plain equi-joins, so Spark splits a node
that holds many edges. Each round is checkpointed; only one count and one
checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import cut


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One step on ``(u, v)``. ``both``: large-star, else small-star."""
    if both:
        e = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    e = e.join(low, "u").withColumn("m", F.least("m", "u"))
    if both:
        out = e.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = (e.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                          F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
                        .alias("e")).select("e.u", "e.v"))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: ``(u, v)`` of one orderable type. Returns ``(node, root)``,
    one row for every node from which a smaller one is reachable; root is the
    smallest. Loops, repeated edges and nulls are harmless
    (nulls are left out). An empty table gives an empty table."""
    e = cut(edges.where("u is not null and v is not null and u <> v").distinct())
    seen = None
    while True:
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = tuple(mark)
        e = cut(_star(_star(e, True), False))
