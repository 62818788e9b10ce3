"""Completion evaluation.

Run results are measured outside Spark and joined in by ``(model,
task_id)``; the outcome rules and the per-model summary are native columns
and one hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completion_text() -> Column:
    """``generated_code``, else ``completion``, else ``''``."""
    return F.coalesce(F.col("generated_code"), F.col("completion"), F.lit(""))


def reference_text() -> Column:
    """``reference`` unless empty, else ``canonical_solution``."""
    return F.coalesce(F.nullif(F.col("reference"), F.lit("")), F.col("canonical_solution"))


def tag_model(df: DataFrame, model: str) -> DataFrame:
    """Constant model tag."""
    return df.withColumn("model", F.lit(model))


def stack(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name (missing columns become NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def split_bad_rows(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """A row that cannot be evaluated goes to a quarantine frame and the
    rest goes on."""
    flag = F.coalesce(bad, F.lit(True))
    return df.where(~flag), df.where(flag)


def match_keys(completions: DataFrame, measurements: DataFrame) -> list[str]:
    """Columns that name a completion: model and task, and ``completion_id`` if
    both sides have it (several completions of one task)."""
    both = set(completions.columns) & set(measurements.columns)
    return ["model", "task_id", *(["completion_id"] if "completion_id" in both else [])]


def check_unique(df: DataFrame, keys: list[str]) -> None:
    """Raise if ``keys`` repeat: a join on them would multiply rows."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"rows repeat {keys}; add a completion_id to both sides")


def outcome_rows(completions: DataFrame, measurements: DataFrame) -> DataFrame:
    """Per completion, ``compile_success`` / ``sim_success`` / ``fidelity``
    / ``depth`` with the reference defaults (0, 0, NULL, NULL without a
    circuit; fidelity only with a non-empty reference that also ran). The
    texts are reduced to two flags before the join. Measurements that repeat
    the key are an error."""
    keys = match_keys(completions, measurements)
    check_unique(measurements, keys)
    ref = reference_text()
    c = completions.select(*keys, (completion_text() != "").alias("_code"),
                           (ref.isNotNull() & (ref != "")).alias("_ref"))
    m = measurements.select(*keys, "has_circuit", "sv_ok", "ref_ok", "fidelity", "depth")
    j = c.join(m, keys, "left")
    circuit = F.coalesce(F.col("has_circuit"), F.lit(False)) & F.col("_code")
    sv = F.coalesce(F.col("sv_ok"), F.lit(False))
    fid_ok = circuit & sv & F.col("_ref") & F.coalesce(F.col("ref_ok"), F.lit(False))
    return j.select(
        *keys,
        F.when(circuit, 1).otherwise(0).cast("int").alias("compile_success"),
        F.when(circuit & sv, 1).otherwise(0).cast("int").alias("sim_success"),
        F.when(fid_ok, F.nullif(F.col("fidelity"), F.lit(float("nan")))).alias("fidelity"),
        F.when(circuit, F.col("depth")).cast("int").alias("depth"))


def summarise(outcomes: DataFrame) -> DataFrame:
    """E4 + E5: per model mean compile and sim rate, mean fidelity and
    interpolated median depth over non-missing values, count of non-missing
    task ids; NULL models dropped; sorted by model; rounding to
    3, 3, 3, 2 digits by multiplying, rounding half to even and dividing. One shuffle; avg/count aggregate partially, the exact median
    keeps a value->count map per group (bounded by distinct depths)."""
    s = (outcomes.where(F.col("model").isNotNull())
         .groupBy("model")
         .agg(F.avg("compile_success").alias("compile_rate"),
              F.avg("sim_success").alias("sim_rate"),
              F.avg("fidelity").alias("mean_fidelity"),
              F.median("depth").alias("median_depth"),
              F.count("task_id").alias("count")))
    return s.select(
        "model",
        *[(F.rint(F.col(c).cast("double") * 10.0 ** n) / 10.0 ** n).alias(c)
          for c, n in (("compile_rate", 3), ("sim_rate", 3), ("mean_fidelity", 3), ("median_depth", 2))],
        "count").orderBy("model")
