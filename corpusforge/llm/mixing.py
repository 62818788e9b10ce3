"""Mixing sources to target weights (operator 4), DataFrame functions only.

Targets: sources in code-point order (null last) weigh ``weights`` in turn and
share the words of the whole corpus; a target stops at ``cap`` times its
source's size and the excess is shared again by weight. The fixed point is a
water level: with sources sorted by ``cap * size / weight``, the first source
whose level fits under its cap fixes the level for all after it.

Systematic sampling: a document is expected ``r = target / source size`` times.
Documents are ranked within their source by size, the prefix sum of expected
copies is ``r * rank``, one offset per source (a hash of seed and source, in
[0, 1)) is added, and a document is emitted once per integer boundary that its
own step crosses: floor(r * rank + u) - floor(r * (rank - 1) + u) times, so
never more than ceil(r) <= cap times.

Ranks without holding a source in one task: a source is cut into size classes
(16 per power of two at most) and a class into about sqrt(N) blocks by a hash
of the id. Blocks are counted with partial aggregation; the counts are
prefix-summed over the classes of a source and over the blocks of a class, and
rows are ranked inside their block only. The largest window holds about
sqrt(N) rows, whatever a source's share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import cut, ready

WORD = r"[^\x20\x09-\x0D]+"
KEY = ["_src", "_null", "_class", "_block"]


def _digest(text, digits: int):
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def targets(sources: DataFrame, weights=(1, 2, 3), cap: float = 3.0) -> DataFrame:
    """``sources``: ``(_src, _null, _size)``, one row per source. Adds
    ``target``. The only step that orders all sources in one place; its input
    has one row per source."""
    order = Window.orderBy("_null", "_src")
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long"))
    s = s.withColumn("_cap", F.lit(float(cap)) * F.col("_size"))
    s = s.withColumn("_lim", F.col("_cap") / F.col("_w"))
    rise = Window.orderBy("_lim", "_null", "_src")
    rest = rise.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = (s.withColumn("_pos", F.row_number().over(rise))
         .withColumn("_before", F.coalesce(F.sum("_size").over(
             rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("_rest", F.sum("_w").over(rest))
         .withColumn("_all", F.sum("_size").over(every)))
    s = s.withColumn("_level", (F.col("_all").cast("double") - F.lit(float(cap)) * F.col("_before")) / F.col("_rest"))
    s = s.withColumn("_fix", F.min_by(F.when(F.col("_level") <= F.col("_lim"), F.col("_level")),
                                      F.when(F.col("_level") <= F.col("_lim"), F.col("_pos"))).over(every))
    return s.select("_src", "_null", F.col("_size").alias("source_size"),
                    F.least("_cap", F.col("_fix") * F.col("_w")).alias("target"))


def mix(df: DataFrame, id_col: str, source_col: str, text_col: str, weights=(1, 2, 3),
        cap: float = 3.0, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``df``: ``(id_col, size, source_size, target,
    copies)``, and ``keep``: a struct ``row`` of those columns.

    ``size`` counts words; null and empty texts have 0. A null source is a
    source. Null ids are ranked like an empty id. Rows that share an id and a
    size are interchangeable, or ordered by their text's hash if columns are kept,
    so reruns agree on the multiset of results. A
    source without words has target 0 and no copies. Columns of any other name
    are ignored unless kept, and then cannot clash."""
    ready(df.sparkSession)
    src = df.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"),
        F.col(source_col).isNull().alias("_null"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
        *([F.struct(*keep).alias("row"), F.xxhash64(F.col(text_col).cast("string")).alias("_tie")] if keep else []))
    bits = F.length(F.bin("_size"))
    src = src.withColumn("_class", bits * 32 + F.call_function(
        "shiftright", F.col("_size"), F.greatest(bits - 4, F.lit(0))).cast("int"))
    thin = cut(src.drop("row", "_tie"))
    n_blocks = max(1, -int(-(thin.count() ** 0.5) // 1))
    block = F.pmod(_digest(F.coalesce(F.col("_id").cast("string"), F.lit("")), 8), F.lit(n_blocks)).alias("_block")
    rows = (src if keep else thin).select("*", block)
    blocks = cut(thin.select("*", block).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_size")))
    classes = blocks.groupBy(*KEY[:3]).agg(F.sum("_n").alias("_n"))
    before = Window.unboundedPreceding, -1
    classes = classes.select(*KEY[:3], F.coalesce(F.sum("_n").over(
        Window.partitionBy(*KEY[:2]).orderBy("_class").rowsBetween(*before)), F.lit(0)).alias("_c0"))
    goal = targets(blocks.groupBy(*KEY[:2]).agg(F.sum("_size").alias("_size")), weights, cap)
    start = (blocks.select(*KEY, F.coalesce(F.sum("_n").over(
        Window.partitionBy(*KEY[:3]).orderBy("_block").rowsBetween(*before)), F.lit(0)).alias("_b0"))
             .join(classes, KEY[:3]).join(goal, KEY[:2])
             .select(*KEY, (F.col("_c0") + F.col("_b0")).alias("_start"), "source_size", "target"))
    rank = F.col("_start") + F.row_number().over(Window.partitionBy(*KEY).orderBy("_size", "_id", *(["_tie"] if keep else [])))
    u = _digest(F.concat(F.lit(seed), F.when(F.col("_null"), "0").otherwise("1"), F.col("_src")), 5) / F.lit(1048576.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = rows.join(start, KEY).withColumn("_rank", rank).withColumn("_rate", rate).withColumn("_u", u)
    copies = F.floor(F.col("_rate") * F.col("_rank") + F.col("_u")) - F.floor(
        F.col("_rate") * (F.col("_rank") - 1) + F.col("_u"))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target",
                      copies.cast("long").alias("copies"), *(["row"] if keep else []))
