"""Exact quantiles of any column in constant memory per group (V3).

Distributed selection: for every wanted rank a bracket ``[lo, hi]`` of values is
kept that holds it, with the number of values below it. A round counts the values
of the brackets by bin (one hash aggregate, at most ``BINS`` rows a bracket),
and a rank's bin, from its least to its greatest value, is the next bracket,
until a bracket is one value. Bins have equal width, but the second round
divides by sign and power of two, so that values of very different size take no
more than seven rounds. Neither values nor counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.session import cut_lineage, join_group_stats

BINS = 4096


def _equal_width(x, lo, hi):
    half = lambda v: v / 2.0  # noqa: E731 -- a difference of halves cannot overflow
    return F.least(F.floor((half(x) - half(lo)) / (half(hi) - half(lo)) * BINS), F.lit(BINS - 1))


def _by_size(x):
    """A number that does not fall as ``x`` rises: its sign and power of two."""
    size = F.floor(F.log2(F.abs(x))) + 1100
    return (F.when(x == 0, F.lit(0)).when(F.abs(x) == float("inf"), F.signum(x) * 5000)
            .otherwise(F.signum(x) * size).cast("long"))


def select_ranks(vals: DataFrame, by: str, ranks: DataFrame) -> DataFrame:
    """``vals(by, _x double)`` without nulls and NaN; ``ranks(by, rank, lo, hi,
    below)`` from 0, derived from a written table. Returns ``(by, rank, value)``. Null groups are left out."""
    open_, done, turn = ranks, [], 0
    while True:
        done.append(open_.where("lo = hi").select(by, "rank", F.col("lo").alias("value")))
        open_ = open_.where("lo < hi")
        if open_.isEmpty():
            out = done[0]
            for d in done[1:]:
                out = out.unionByName(d)
            return out
        brackets = open_.groupBy(by, "lo", "hi", "below").agg(F.collect_set("rank").alias("ranks"))   # a few rows
        x = F.col("_x")
        inside = join_group_stats(vals, brackets.drop("ranks"), by).where((x >= F.col("lo")) & (x <= F.col("hi")))
        endless = (F.col("lo") == -float("inf")) | (F.col("hi") == float("inf"))
        bin_ = _by_size(x) if turn == 1 else F.when(endless, _by_size(x)).otherwise(_equal_width(x, F.col("lo"), F.col("hi")))
        counts = (inside.groupBy(by, "lo", "hi", "below", bin_.alias("bin"))
                  .agg(F.count(F.lit(1)).alias("c"), F.min("_x").alias("mn"), F.max("_x").alias("mx")))
        before = Window.partitionBy(by, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("start", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        open_ = cut_lineage(counts.join(brackets.drop("below"), [by, "lo", "hi"]).select(
            by, F.explode("ranks").alias("rank"), "mn", "mx", "start", "c")
            .where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("c")))
            .select(by, "rank", F.col("mn").alias("lo"), F.col("mx").alias("hi"), F.col("start").alias("below")))
        turn += 1


def exact_quantiles(df: DataFrame, col: str, by: str, probs: list[float]) -> DataFrame:
    """``(by, n, q array<double>)``: quantiles of ``col`` per group, linearly
    interpolated between the two nearest values, over values that are neither
    null nor NaN. Groups without such a value, and the null group, have no row."""
    x = F.col(col).cast("double")
    vals = df.select(by, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x") & F.col(by).isNotNull())
    size = cut_lineage(vals.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi")))
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    below, above = [F.floor(a) for a in at], [F.ceil(a) for a in at]
    found = select_ranks(vals, by, size.select(by, F.explode(F.array_distinct(F.array(*below, *above))).alias("rank"),
                                               "lo", "hi", F.lit(0).cast("long").alias("below")))
    values = F.map_from_entries("found")
    a, b = [F.element_at(values, r) for r in below], [F.element_at(values, r) for r in above]
    q = F.array(*[F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (p - F.floor(p))) for lo, hi, p in zip(a, b, at)])
    per_group = found.groupBy(by).agg(F.collect_list(F.struct("rank", "value")).alias("found"))
    return per_group.join(size.select(by, "n"), by).select(by, "n", q.alias("q"))
