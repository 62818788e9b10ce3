"""Command line: the reference's stages as Spark jobs.

    python -m corpusforge curate   --files DIR --out DIR [--keyword K] [--variant] [--threshold T]
    python -m corpusforge evaluate --completions DIR --measurements PATH --out DIR
    python -m corpusforge report   --out DIR

``evaluate`` expects one folder per model under ``--completions``
(``<model>/`` with JSON Lines, or JSON array files with ``--arrays``) and a
Parquet measurement table (``model, task_id, has_circuit, sv_ok, counts_ok,
ref_ok, fidelity, depth, gates``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusforge.operators import evaluate as ev
from corpusforge.operators import report
from corpusforge.plans.curate import curate
from corpusforge.session import ensure_checkpoint_dir
from corpusforge.sources import readers as rd
from corpusforge.sources import writers as wr


def _curate(spark, a):
    files = rd.read_source_files(spark, a.files)
    cur = curate(files, keyword=a.keyword, variant=a.variant, threshold=a.threshold)
    wr.write_tasks_json(cur.tasks.drop("task_no"), f"{a.out}/tasks")
    if not a.variant:
        wr.write_preferences_csv(cur.preferences, f"{a.out}/preferences")
    cur.difficulty.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.out}/difficulty")
    cur.quarantine.write.mode("overwrite").option("header", True).csv(f"{a.out}/quarantine")


def _evaluate(spark, a):
    jvm_fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = jvm_fs.Path(a.completions)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    frames = []
    for st in fs.listStatus(root):
        if st.isDirectory():
            model = st.getPath().getName()
            df = rd.read_completions(spark, st.getPath().toString(), multiline=a.arrays)
            good, bad = ev.split_bad_rows(df, F.col("_corrupt_record").isNotNull())
            frames.append(ev.tag_model(good, model))
            ev.tag_model(bad, model).write.mode("overwrite").json(f"{a.out}/quarantine/{model}")
    outcomes = ev.outcome_rows(ev.stack(*frames), spark.read.parquet(a.measurements))
    wr.write_outcomes_csv(outcomes, f"{a.out}/outcomes")
    wr.write_summary_csv(ev.summarise(outcomes),
                         f"{a.out}/summary")


def _report(spark, a):
    summary = rd.read_summary_csv(spark, f"{a.out}/summary")
    report.rates_long(summary).coalesce(1).write.mode("overwrite").option("header", True) \
        .csv(f"{a.out}/rates_long")
    outcomes = rd.read_outcomes_csv(spark, f"{a.out}/outcomes")
    if outcomes is None:          # the detail table is optional, as in the reference
        return
    report.histogram(outcomes, "fidelity", "model", 20).write.mode("overwrite") \
        .option("header", True).csv(f"{a.out}/fidelity_hist")
    report.box_stats(outcomes, "depth", "model").write.mode("overwrite") \
        .option("header", True).csv(f"{a.out}/depth_box")


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="corpusforge")
    sub = p.add_subparsers(dest="cmd", required=True)
    c = sub.add_parser("curate")
    c.add_argument("--files", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--keyword", default="qiskit")
    c.add_argument("--variant", action="store_true")
    c.add_argument("--threshold", type=float, default=0.95)
    e = sub.add_parser("evaluate")
    e.add_argument("--completions", required=True)
    e.add_argument("--measurements", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--arrays", action="store_true")
    r = sub.add_parser("report")
    r.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"corpusforge-{a.cmd}").getOrCreate()
    ensure_checkpoint_dir(spark)
    {"curate": _curate, "evaluate": _evaluate, "report": _report}[a.cmd](spark, a)


if __name__ == "__main__":
    main()
