"""Incremental reward scoring with Structured Streaming.

The same R1-R11 columns as :func:`corpusforge.plans.score.score`, applied to
completion files as they land (JSON Lines, one folder per model), joined to
static task and measurement tables (stream-static joins, no state kept).
Offsets and the sink's commit log live under the shared checkpoint root, so
a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from corpusforge.plans.score import score
from corpusforge.session import scratch_path

COMPLETION_TEXTS = StructType([StructField("model", StringType()),
                               StructField("task_id", StringType()),
                               StructField("text", StringType())])


def completion_stream(spark: SparkSession, folder: str,
                      max_files_per_trigger: int = 1000) -> DataFrame:
    """Completion texts ``(model, task_id, text)`` arriving as JSON Lines."""
    return (spark.readStream.schema(COMPLETION_TEXTS)
            .option("maxFilesPerTrigger", max_files_per_trigger).json(folder))


def start_scoring(completions: DataFrame, tasks: DataFrame, measurements: DataFrame,
                  out_path: str, checkpoint: str | None = None,
                  available_now: bool = False) -> StreamingQuery:
    """Score a completion stream into a Parquet table partitioned by model."""
    scored = score(completions, tasks, measurements)
    ckpt = checkpoint or scratch_path(completions.sparkSession, "score-stream")
    w = (scored.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", ckpt).partitionBy("model").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
