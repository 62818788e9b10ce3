"""Sinks (S5, S7, S10 and the outcome detail table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.numbering import global_index
from corpusforge.sources import schemas

# Spark's CSV writer trims values unless told not to, which would destroy code
# indentation; NULL gets a marker distinct from the empty string.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "nullValue": "\u0001",
}


def _strings(df: DataFrame, change) -> DataFrame:
    return df.select(*[change(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def mark_nulls(df: DataFrame) -> DataFrame:
    """Double the marker at the start of texts, so that none reads as NULL."""
    return _strings(df, lambda c: F.when(c.startswith("\u0001"), F.concat(F.lit("\u0001"), c)).otherwise(c))


def unmark_nulls(df: DataFrame) -> DataFrame:
    return _strings(df, lambda c: F.when(c.startswith("\u0001\u0001"), F.substring(c, 2, 1 << 30)).otherwise(c))


def write_tasks_json(tasks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines, one file per partition (splittable, parallel)."""
    tasks.write.mode(mode).json(path)


def write_array(df: DataFrame, path: str, order_cols: list[str], mode: str = "overwrite") -> None:
    """S5, the array form: the part files under ``path``, one after the other
    in the order of their names, are one JSON array of the rows in
    ``order_cols`` order (a unique key). Every task writes its own piece; no
    task and no driver holds the rows. ``cat`` or a merging copy of the folder
    gives the single file; :func:`readers.read_array_elements` reads it either
    way. Null fields are written as ``null``; no rows give ``[]``."""
    rows = global_index(df.select(F.struct(*df.columns).alias("row"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)]),
                        [f"_o{i}" for i in range(len(order_cols))], "_at")
    n = rows.count()
    if n == 0:
        df.sparkSession.range(1, numPartitions=1).select(F.lit("[]")).write.mode(mode).text(path)
        return
    text = F.to_json("row", {"ignoreNullFields": "false"})
    rows.select(F.concat(F.when(F.col("_at") == 0, F.lit("[\n")).otherwise(F.lit("")), text,
                         F.when(F.col("_at") == n - 1, F.lit("\n]")).otherwise(F.lit(",")))).write.mode(mode).text(path)


def write_preferences_csv(prefs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header, every field quoted, ``""`` escaping, whitespace
    kept, multi-line values as is."""
    mark_nulls(prefs).write.mode(mode).options(**CSV_OPTIONS).option("quoteAll", True).csv(path)


def write_summary_csv(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file with header; the summary has one row per model."""
    summary.coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_outcomes_csv(outcomes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-completion detail table (read by the plots, S11). Columns in the
    order of the schema; ``completion_id`` is NULL where there is none."""
    if "completion_id" not in outcomes.columns:
        outcomes = outcomes.withColumn("completion_id", F.lit(None).cast("long"))
    mark_nulls(outcomes.select(*schemas.OUTCOMES.names)).write.mode(mode).options(**CSV_OPTIONS).option("quoteAll", True).csv(path)
