"""Plot data as tables (V1-V3): the numbers behind the bar chart, the
fidelity histogram and the depth box plot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.quantiles import exact_quantiles
from corpusforge.session import cut_lineage, join_group_stats


def rates_long(summary: DataFrame, id_col: str = "model",
               value_cols=("compile_rate", "sim_rate")) -> DataFrame:
    """V1: wide -> long ``(model, metric, rate)``."""
    return summary.unpivot([id_col], list(value_cols), "metric", "rate")


def histogram(df: DataFrame, col: str, by: str, bins: int = 20) -> DataFrame:
    """V2: equal-width bins shared by all groups (edges from the global
    min/max, last bin closed, a constant column gets the range v-0.5..v+0.5),
    counts per (group, bin) for non-missing values; empty bins are omitted.
    Bin assignment reproduces ``numpy.histogram`` including its edge
    correction. The only driver traffic is the two range scalars."""
    vals = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col)))
    lo, hi = vals.agg(F.min(col), F.max(col)).first()
    if lo is None:
        return df.sparkSession.createDataFrame(
            [], f"{by} string, bin int, bin_lo double, bin_hi double, count long")
    lo, hi = float(lo), float(hi)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    norm = bins / (hi - lo)
    x = F.col(col).cast("double")
    edge = lambda k: k.cast("double") * F.lit(step) + F.lit(lo)
    b0 = F.least(F.floor((x - F.lit(lo)) * F.lit(norm)).cast("int"), F.lit(bins - 1))
    b1 = F.when(x < edge(b0), b0 - 1).otherwise(b0)
    b2 = F.when((b1 < bins - 1) & (x >= edge(b1 + 1)), b1 + 1).otherwise(b1)
    out = (vals.select(F.col(by), b2.alias("bin"))
           .groupBy(by, "bin").agg(F.count(F.lit(1)).alias("count")))
    return out.select(by, "bin", edge(F.col("bin")).alias("bin_lo"),
                      F.when(F.col("bin") == bins - 1, F.lit(hi))
                      .otherwise(edge(F.col("bin") + 1)).alias("bin_hi"), "count")


def box_stats(df: DataFrame, col: str, by: str, whis: float = 1.5) -> DataFrame:
    """V3: per group Q1, median, Q3 (linear interpolation), whiskers at the
    most extreme values within ``whis * IQR`` (clamped to the quartiles),
    number of outliers beyond them. The quartiles are selected by refining
    ranges of values (constant memory per group, whatever the column), then one
    pass with the group's quartiles broadcast (size-checked) finds whiskers and
    outliers. A value is beyond a whisker exactly when it is beyond the fence.
    Null and NaN values, and the null group, are left out."""
    vals = (df.select(by, F.col(col).cast("double").alias("_x"))
            .where(F.col("_x").isNotNull() & ~F.isnan("_x")))      # NaN is a missing value
    q = exact_quantiles(df, col, by, [0.25, 0.5, 0.75]).select(
        by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    hi_fence = F.col("q3") + whis * iqr
    lo_fence = F.col("q1") - whis * iqr
    w = (join_group_stats(vals, cut_lineage(q), by)
         .groupBy(by, "q1", "median", "q3")
         .agg(F.max(F.when(F.col("_x") <= hi_fence, F.col("_x"))).alias("_hi"),
              F.min(F.when(F.col("_x") >= lo_fence, F.col("_x"))).alias("_lo"),
              F.count(F.when((F.col("_x") > hi_fence) | (F.col("_x") < lo_fence), 1))
               .alias("n_outliers")))
    return w.select(by, "q1", "median", "q3",
                    F.when(F.col("_lo").isNull() | (F.col("_lo") > F.col("q1")), F.col("q1"))
                     .otherwise(F.col("_lo")).alias("whisker_lo"),
                    F.when(F.col("_hi").isNull() | (F.col("_hi") < F.col("q3")), F.col("q3"))
                     .otherwise(F.col("_hi")).alias("whisker_hi"),
                    "n_outliers")


def box_outliers(df: DataFrame, col: str, by: str, whis: float = 1.5) -> DataFrame:
    """V3 fliers as rows ``(group, value)``."""
    st = box_stats(df, col, by, whis).select(by, "whisker_lo", "whisker_hi")
    x = F.col(col).cast("double")
    return (join_group_stats(df.where(x.isNotNull() & ~F.isnan(x)), cut_lineage(st), by)
            .where((x < F.col("whisker_lo")) | (x > F.col("whisker_hi")))
            .select(by, x.alias(col)))
