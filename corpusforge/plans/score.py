"""Reward scoring and evaluation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.rewards import prepare, reward_columns
from corpusforge.functions.text import py_strip
from corpusforge.operators.evaluate import check_unique, match_keys


def score(completions: DataFrame, tasks: DataFrame, measurements: DataFrame,
          rewards=None, text_col: str = "text",
          keys=None) -> DataFrame:
    """One wide reward table: a row per completion, a ``r_<name>`` column per
    registered reward (R11). Completions meet their task's reference by an
    equi-join on ``task_id`` (R10) and their run results by ``keys``; a
    missing task or measurement scores 0, never a misaligned neighbour.
    ``keys`` default to model, task and, where both sides have it,
    ``completion_id``; tasks or measurements that repeat their key are an
    error. Solutions are reduced to a flag before the join."""
    keys = list(keys or match_keys(completions, measurements))
    check_unique(measurements, keys)
    check_unique(tasks, ["task_id"])
    refs = tasks.select("task_id", (py_strip(F.coalesce("canonical_solution", F.lit(""))) != "")
                        .alias("_has_ref"))
    c = completions.join(refs, "task_id", "left").join(measurements, keys, "left")
    p = prepare(c, text_col)
    has_ref = F.coalesce(F.col("_has_ref"), F.lit(False))
    p = p.withColumn("ref_ok", F.coalesce(F.col("ref_ok"), F.lit(False)) & has_ref)
    return p.select(*keys, *reward_columns(p, rewards))
