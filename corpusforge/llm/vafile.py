"""Exact top-k inner products with a vector-approximation file (operator 3).

* Distinct vectors are classes; a class keeps its ``k + 1`` smallest ids, which
  is all that a query of its own can need. Copies cost nothing more.
* The approximation file holds one byte a component: the cell of a uniform
  grid of ``2 ** bits`` cells between the smallest and largest component.
* Scan: for a block of at most ``block`` query classes, every partition of the
  file computes ``s = q . (lower cell edges)`` by one matrix product. The exact
  product lies between ``s + (w - 1) * (sum of negative q)`` and ``s + (w - 1)
  * (sum of positive q)`` for cells of width ``w``. A class stays a candidate
  if its upper bound reaches the ``(k + 1)``-th best lower bound.
* Exact vectors are read in the order of the bounds: first the ``2 * (k + 1)``
  candidates of best bound, then those whose upper bound still reaches the
  ``(k + 1)``-th exact product found. The result is then certain, ties
  included.

The file is scanned once for each block of queries and only candidates are
joined with exact vectors. The queries are a stated set; a block is bounded, so
it is sent to the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import cut, ready

BLOCK = 4096


def usable(vec) -> Column:
    """Not null, no null and no non-finite component, not empty."""
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _cells(low: int, width: int):
    def run(batches):
        for b in batches:
            v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            cells = ((v - low) // width).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r.tobytes() for r in cells], pa.binary())], names=["c", "cells"])
    return run


def _scan(shared, low: int, width: int, want: int):
    def run(batches):
        ids, q = shared.value
        spread = (np.abs(q).sum(1) * (width - 1)).astype(np.float64)
        qt = q.T.astype(np.float64)
        best = np.full((len(q), want), -np.inf)     # best lower sums so far
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def settle():
            if not held:
                return []
            i, c, s = (np.concatenate(x) for x in zip(*held))
            ok = s >= best[i, 0] - spread[i]
            return [(i[ok], c[ok], s[ok])]

        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                cell = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                s = (cell.astype(np.float64) * width + low) @ qt        # class x query
                both = np.concatenate([best, s.T], axis=1)
                best = np.partition(both, both.shape[1] - want, axis=1)[:, -want:]
                best.sort(axis=1)
                c, i = np.nonzero(s >= best[:, 0] - spread)
                held.append((i, part.column(0).to_numpy()[c], s[c, i]))
                size += len(i)
                if size > 1 << 20:
                    held = settle()
                    size = sum(len(x[0]) for x in held)
        for i, c, s in settle():
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[i]), pa.array(c), pa.array(s.astype(np.int64)), pa.array(spread[i].astype(np.int64))],
                names=["q", "c", "s", "spread"])
    return run


def _exact(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    a = classes.select(F.col("c").alias("q"), F.col("v").alias("qv"))
    dot = F.aggregate(F.zip_with("v", "qv", lambda x, y: x * y), F.lit(0).cast("long"), lambda t, x: t + x)
    return pairs.join(classes.select("c", "v"), "c").join(a, "q").withColumn("score", dot).drop("v", "qv")


def _kth(rows: DataFrame, value: str, k: int) -> DataFrame:
    """The k-th largest ``value`` of each query that has that many rows."""
    w = Window.partitionBy("q").orderBy(F.desc(value))
    return rows.withColumn("_r", F.row_number().over(w)).where(f"_r = {k}").select("q", F.col(value).alias("kth"))


def top_k(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 5, bits: int = 8,
          block: int = BLOCK) -> DataFrame:
    """``df[vec_col]``: integer vectors. ``(query_id, rank, vec_id, score)``: for
    every row with ``is_query`` the ``k`` highest inner products with rows of
    other ids, ties to the smaller id; fewer if there are fewer.

    Rows with a null id, a null or empty vector or a null component take no
    part. Rows that repeat id and vector count once; vectors of another length
    than the query's are no candidates of it."""
    spark = df.sparkSession
    ready(spark)
    rows = (df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<bigint>").alias("v"),
                      is_query.alias("ask"))
            .where(F.col("id").isNotNull() & usable(F.col("v"))).distinct())
    near = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k + 1)
    classes = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                  .withColumn("c", F.monotonically_increasing_id()))
    asks = cut(rows.where("ask").join(classes.select("c", "v"), "v").select("id", "c", F.size("v").alias("dim")))
    found = []
    kind = rows.schema["id"].dataType.simpleString()
    for dim in [r["dim"] for r in asks.select("dim").distinct().collect()]:
        own = classes.where(F.size("v") == dim)
        low, high = own.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
        width = (high - low + 1 + 2 ** bits - 1) // 2 ** bits
        file = cut(own.select("c", "v").mapInArrow(_cells(low, width), "c long, cells binary"))
        queries = asks.where(F.col("dim") == dim).select("c").distinct()
        n_blocks = -(-queries.count() // block)
        queries = cut(queries.join(own, "c").select("c", "v", F.pmod(F.xxhash64("c"), F.lit(n_blocks)).alias("b")))
        for b in range(n_blocks):
            some = queries.where(F.col("b") == b).orderBy("c").toPandas()
            if not len(some):
                continue
            shared = spark.sparkContext.broadcast((some["c"].to_numpy(), np.array(some["v"].tolist(), np.int64)))
            cand = cut(file.mapInArrow(_scan(shared, low, width, k + 1), "q long, c long, s long, spread long"))
            kth = _kth(cand, "s", k + 1)
            cand = cand.join(kth, "q", "left").where("kth is null or s >= kth - spread").drop("kth")
            order = Window.partitionBy("q").orderBy(F.desc("s"), "c")
            cand = cut(cand.withColumn("r", F.row_number().over(order)))
            first = cut(_exact(cand.where(F.col("r") <= 2 * (k + 1)), own))
            kth = _kth(first, "score", k + 1)
            # the upper bound is s + (w - 1) * (sum of positive q) <= s + spread
            rest = (cand.where(F.col("r") > 2 * (k + 1)).join(kth, "q", "left")
                    .where("kth is null or s + spread >= kth").drop("kth"))
            hits = first.unionByName(_exact(rest, own)).join(own.select("c", "ids"), "c").select(
                "q", "score", F.explode("ids").alias("vec_id"))
            by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
            best = (hits.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= k + 1)
                    .select("q", "score", "vec_id"))        # at most block * (k + 1) rows
            mine = asks.join(F.broadcast(queries.where(F.col("b") == b).select("c")), "c")
            found.append(cut(mine.join(F.broadcast(best), mine.c == best.q).where("id <> vec_id")
                             .select(F.col("id").alias("query_id"), "vec_id", "score")))
    if not found:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (out.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
