"""Session helpers: building a local session for tests/bench and finding the
shared scratch folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "corpusforge") -> SparkSession:
    """Local session for tests and the bench. On a cluster use the session the
    platform gives you; nothing here is required by the library."""
    master = master or os.environ.get("SPARK_MASTER", "local[8]")
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder. The cluster's setting wins; a
    private folder is made only in local mode with nothing configured (tests);
    a cluster without the setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="corpusforge-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root, for written
    intermediate tables and round-trip files (never a machine-local temp dir
    on a cluster)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/corpusforge/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame | Iterable[DataFrame], name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back. Cuts
    lineage like a checkpoint, and the planner's sizes as well: a checkpoint
    keeps the estimate of its plan, which a loop that joins its own results
    would multiply with itself round by round. Several frames of one schema
    are written one after the other and read back as one."""
    path = None
    for part in [df] if isinstance(df, DataFrame) else df:
        path = path or scratch_path(part.sparkSession, name)
        part.write.mode("append").parquet(path)
    return part.sparkSession.read.schema(part.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete the files of tables written under the scratch folder that nothing
    reads any more, so that a call of many steps does not keep them all. Files
    elsewhere are left alone."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "x")).getParent()
        top = root.toUri().getPath() + "/"
        files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toUri().getPath() for f in table.inputFiles()]
        for folder in {f[len(top):].split("/")[0] for f in files if f.startswith(top)}:
            path = jvm.org.apache.hadoop.fs.Path(root, folder)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, the shuffle files of a job that has ended go at once instead of
    when the driver happens to collect its garbage: a call of many steps, each
    written, then takes the disk of its largest step, not of their sum."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """Round-robin a thin input (fewer partitions than the cluster has
    cores, e.g. one big row group) before heavy per-row work. A many-file
    input at scale already has enough splits and is left as is, unless a task
    would get more than ``rows_per_task`` rows on average, where that is given:
    small rows pack many into a split. The rows are counted for it."""
    try:
        target = df.sparkSession.sparkContext.defaultParallelism
        if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
            return df  # already shuffled upstream: spark.sql.shuffle.partitions wide
        have = df.rdd.getNumPartitions()
    except Exception:  # no JVM handle (e.g. a remote session): leave it to the planner
        return df
    if rows_per_task:
        target = max(target, -(-df.count() // rows_per_task))
    return df.repartition(target) if have < target else df


# Largest per-group stats table (rows times the bytes of a row, 16 a column)
# broadcast to every task; beyond it the join is left to the planner
# (sort-merge with AQE skew splitting).
BROADCAST_MAX_BYTES = 48 << 20


def join_group_stats(rows: DataFrame, stats: DataFrame, on, how: str = "inner",
                     max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Attach a per-group stats table (one row per group) to row-level data.
    A few hot groups would put whole groups into single tasks under a
    hash-partitioned join, so the stats side is broadcast when its size is
    checked to be small; otherwise the planner picks (AQE splits skew).
    ``stats`` is read twice: give a written or checkpointed one."""
    if stats.count() * 16 * len(stats.columns) <= max_bytes:
        from pyspark.sql import functions as F
        return rows.join(F.broadcast(stats), on, how)
    return rows.join(stats, on, how)


def bucketed_table(df: DataFrame, col: str, buckets: int, name: str, made: list[str],
                   parts: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed by ``col`` under the shared checkpoint
    folder and read it back. Cuts lineage like a checkpoint, and unlike a
    checkpoint under AQE the planner keeps knowing the rows are hash
    partitioned by ``col``, so later per-key windows, aggregates and joins on
    it need no shuffle. One file per bucket (repartitioned first) and value of
    ``parts``, whose columns divide the folders. ``made`` receives the table's
    name, for the caller to drop; its files, under the checkpoint folder, stay
    until :func:`drop_written` is called on it."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    table = "cf_" + name.replace("-", "_") + "_" + uuid.uuid4().hex[:12]
    out = df.repartition(buckets, col).write.option("path", path).bucketBy(buckets, col)
    (out.partitionBy(*parts) if parts else out).mode("error").saveAsTable(table)
    made.append(table)
    return spark.table(table)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusforge`` importable in the Python workers (the extraction
    pass and the structure-check UDF reference its functions), wherever the
    driver was started: the package is zipped once per application and
    added with ``addPyFile``, which distributes it to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="corpusforge-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
