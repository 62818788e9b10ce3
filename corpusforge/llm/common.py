"""Shared helpers of the training-data operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.session import cut_lineage, ensure_checkpoint_dir, ship_package

#: Largest side that is sent to every executor; larger sides are shuffled.
BROADCAST_BYTES = 48 << 20


#: Bytes of a batch that goes to Python, where the session leaves Spark's own
#: value: a batch is held by the JVM, by the worker and as Python objects.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ready(spark: SparkSession) -> None:
    """Checkpoint folder, batch size and package on the executors; every operator
    calls it."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    if spark.conf.get(_BATCH) in ("64MB", "67108864b"):      # Spark's own value
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    return cut_lineage(df)


def join_checked(big: DataFrame, small: DataFrame, on, how: str, small_bytes: int,
                 limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a large side with one of measured size: broadcast up to ``limit``
    bytes, else a shuffle join, whose skewed partitions Spark splits."""
    return big.join(F.broadcast(small) if small_bytes <= limit else small, on, how)


def chunks(lengths, limit: int):
    """``(start, end)`` runs of consecutive items whose lengths add up to about
    ``limit``; an item above the limit is a run of its own."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def slices(batch: pa.RecordBatch, column: int, limit: int):
    """A batch in runs of rows whose strings in ``column`` add up to about
    ``limit`` bytes, so that only a run at a time becomes Python objects."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, j in chunks(size, limit):
        yield batch.slice(i, j - i)


def merge_labels(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the pairs ``(a, b)`` in ``lab``, where every label is the
    smallest member of its set; done in place."""
    while True:
        la, lb = lab[a], lab[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab[:] = up
