"""Inputs derived from the shared tables, built the same way in Spark and in
the DuckDB oracle (see ``oracle.py``). The shared tables hold no Python code,
so source files are generated from ``part`` rows; completions and run
measurements come from ``conversations`` and ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.operators.extract import FILES
from corpusforge.operators.tasks import TASK_PREFIX
from corpusforge.session import spread

NL = "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- source files from `part` ------------------------------------------------
# A file per part k: one graded function part_k with A = p_size % 20
# assignments, C = p_partkey % 4 print calls and, when p_partkey % 3 = 0, an
# `if` with one assignment (stmts = 2 + A + 2B, calls = C, branches = B); a
# class with a method, a test_ function, a one-line function and a helper.
# Every 17th file gets a Python 2 print statement and does not parse.

def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small rows of ``part`` in tasks of ``FILES``: one split of the table
    holds many files' worth, so texts are built after the rows are dealt out."""
    return spread(table(spark, sf_dir, "part"), FILES)


def part_function(k: Column, name: Column, size: Column) -> Column:
    a = (size % 20).cast("int")
    c = (k % 4).cast("int")
    return F.concat(
        F.lit("def part_"), k.cast("string"), F.lit("(n):" + NL + '    """'), name,
        F.lit('."""' + NL),
        F.repeat(F.lit("    n = n + 1" + NL), a),
        F.repeat(F.lit("    print(n)" + NL), c),
        F.when(k % 3 == 0, F.lit("    if n > 0:" + NL + "        n = n - 1" + NL)).otherwise(F.lit("")),
        F.lit("    return n"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    k = F.col("p_partkey")
    ks = k.cast("string")
    body = F.concat(
        F.lit("import math" + NL + NL + NL),
        part_function(k, F.col("p_name"), F.col("p_size")),
        F.lit(NL + NL + NL + "class Part"), ks, F.lit(":" + NL + "    def method_"), ks,
        F.lit("(self):" + NL + "        return "), ks,
        F.lit(NL + NL + NL + "def test_part_"), ks,
        F.lit("():" + NL + "    assert part_"), ks, F.lit("(1) is not None" + NL + NL + NL + "def s"),
        ks, F.lit("(): pass" + NL + NL + NL + "def helper_"), ks,
        F.lit("(x):" + NL + "    return x" + NL),
        F.when(k % 17 == 0, F.lit(NL + "print 'legacy'" + NL)).otherwise(F.lit("")))
    return p.select(
        F.concat(F.lit("org/"), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("repo"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/part_"), ks, F.lit(".py")).alias("path"),
        F.lit(200).alias("status"),
        body.alias("content"))


# ---- tasks from `documents` ----------------------------------------------------

def document_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))     # whole texts: heavy per-row work
    return d.select(
        "doc_id",
        F.concat(F.lit(TASK_PREFIX + "/"), F.col("doc_id").cast("string")).alias("task_id"),
        F.concat(F.lit("# "), F.col("source"), F.lit(NL + NL + "# Implement `doc_"),
                 F.col("doc_id").cast("string"), F.lit("` below.")).alias("prompt"),
        F.col("text").alias("canonical_solution"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("entry_point"),
        F.lit("basic").alias("difficulty_scale"))


# ---- completions from `conversations` -----------------------------------------
# Six shapes on (conv_id + turn) % 6: well formed; no closing tag; two answer
# blocks; no tags; a banned call; two functions. Import line on
# (conv_id + turn) % 4: proper / deprecated / none / proper (from-form).

def completion_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = table(spark, sf_dir, "conversations")
    v = ((F.col("conv_id") + F.col("turn")) % 6).cast("int")
    imp = ((F.col("conv_id") + F.col("turn")) % 4).cast("int")
    fn = F.concat(F.lit("def f_"), F.col("conv_id").cast("string"), F.lit("_"),
                  F.col("turn").cast("string"), F.lit("(n):" + NL + "    return n + "),
                  F.length("text").cast("string"))
    imp_line = (F.when(imp == 0, F.lit("import qiskit" + NL))
                .when(imp == 1, F.lit("from qiskit import Aer" + NL))
                .when(imp == 2, F.lit(""))
                .otherwise(F.lit("from qiskit import QuantumCircuit" + NL)))
    code = F.concat(imp_line, fn)
    reasoning = F.concat(F.lit("<reasoning>"), F.col("text"), F.lit("</reasoning>" + NL))
    text = (F.when(v == 0, F.concat(reasoning, F.lit("<answer>" + NL), code, F.lit(NL + "</answer>")))
            .when(v == 1, F.concat(reasoning, F.lit("<answer>" + NL), code))
            .when(v == 2, F.concat(reasoning, F.lit("<answer>"), code,
                                   F.lit("</answer>" + NL + "<answer>second</answer>")))
            .when(v == 3, F.col("text"))
            .when(v == 4, F.concat(reasoning, F.lit("<answer>" + NL), code,
                                   F.lit(NL + "    os.system('ls')" + NL + "</answer>")))
            .otherwise(F.concat(reasoning, F.lit("<answer>" + NL), code,
                                F.lit(NL + NL + "def g(m):" + NL + "    return m" + NL + "</answer>"))))
    return cv.select(
        "conv_id", "turn",
        F.when(F.col("turn") % 2 == 0, F.lit("GRPO")).otherwise(F.lit("ORPO")).alias("model"),
        F.concat(F.lit(TASK_PREFIX + "/"), (F.col("conv_id") * 8 + F.col("turn")).cast("string")).alias("task_id"),
        text.alias("text"))


# ---- run measurements from `events` (FIXTURES.md section 3) --------------------

def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    has = F.coalesce(F.col("event_type") != "error", F.lit(False))
    sv = has & (eid % 5 != 0)
    return e.select(
        F.when(eid % 2 == 0, F.lit("GRPO")).otherwise(F.lit("ORPO")).alias("model"),
        F.concat(F.lit(TASK_PREFIX + "/"), F.floor(eid / 2).cast("string")).alias("task_id"),
        has.alias("has_circuit"),
        sv.alias("sv_ok"),
        (sv & (eid % 7 != 0)).alias("counts_ok"),
        (eid % 11 != 0).alias("ref_ok"),
        F.when(sv & (eid % 11 != 0), (eid % 101) / 100.0).alias("fidelity"),
        F.when(has, F.col("user_id") % 50).cast("int").alias("depth"),
        F.when(has, F.col("user_id") % 200).cast("int").alias("gates"))


#: Completions per task and model in the variants with generations.
GENERATIONS = 2


def generations(df: DataFrame) -> DataFrame:
    """The same rows as ``GENERATIONS`` completions of each task: task ``n`` is
    generation ``n % 2`` of task ``n // 2``."""
    n = F.split("task_id", "/")[1].cast("long")
    return df.withColumns({
        "completion_id": n % GENERATIONS,
        "task_id": F.concat(F.lit(TASK_PREFIX + "/"), F.floor(n / GENERATIONS).cast("string"))})


def completion_records(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    """Evaluation-side completion records per event (one per (model,
    task)); every 13th is a malformed entry (not an object)."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    ids = eid.cast("string")
    rec = F.struct(
        F.concat(F.lit(TASK_PREFIX + "/"), F.floor(eid / 2).cast("string")).alias("task_id"),
        F.when(eid % 3 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("qc = build_"), ids, F.lit("()"))).alias("generated_code"),
        F.when(eid % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("completion_"), ids)).alias("completion"),
        F.when(eid % 4 == 0, F.lit("")).when(eid % 4 == 1, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("ref_"), ids)).alias("reference"),
        F.when(eid % 9 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("sol_"), ids)).alias("canonical_solution"))
    line = F.when(eid % 13 == 0, F.lit('"broken entry"')).otherwise(F.to_json(rec, {"ignoreNullFields": "true"}))
    return e.select(*keep, F.when(eid % 2 == 0, F.lit("GRPO")).otherwise(F.lit("ORPO")).alias("model"),
                    line.alias("value"))


#: Events per array file; the last bracket of every fifth file is missing.
FILE_EVENTS = 1000


def completion_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as one JSON array per file: ``(model, file, value)``."""
    lines = completion_records(spark, sf_dir, keep=("event_id",))
    items = F.sort_array(F.collect_list(F.struct("event_id", "value")))
    files = (lines.withColumn("file", F.floor(F.col("event_id") / FILE_EVENTS))
             .groupBy("model", "file").agg(items.alias("items")))
    body = F.concat(F.lit("[" + NL), F.array_join(F.col("items.value"), "," + NL))
    return files.select("model", "file", F.when(F.col("file") % 5 == 4, body)
                        .otherwise(F.concat(body, F.lit(NL + "]"))).alias("value"))


# ---- source files with copies, from `part` ----------------------------------------
# Part k holds one function of group k // 4. Members 0 and 1 are exact copies,
# member 2 has one word more (the others, 21 or more, are the first one's) and
# member 3 is written with names of its own. The body is a docstring, assignments
# or calls by group. Every fifth file lacks the keyword, every fifth spells it in
# capitals, every eleventh was not fetched.

def copied_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    g = F.floor(k / 4).cast("string")
    own = F.when(k % 4 == 3, F.concat(F.lit("u"), k.cast("string"))).otherwise(F.concat(F.lit("g"), g))
    names = [F.concat(F.lit(f"s{i}_"), own) for i in range(17)]
    kind = F.floor(k / 4) % 3
    body = (F.when(kind == 0, F.concat(F.lit('    """'), F.concat_ws(" ", *names), F.lit('"""' + NL)))
            .when(kind == 1, F.concat(*[F.concat(F.lit("    "), n, F.lit(" = 1" + NL)) for n in names]))
            .otherwise(F.concat(*[F.concat(F.lit("    "), n, F.lit("()" + NL)) for n in names])))
    code = F.concat(F.lit("def make_"), own, F.lit("():" + NL), body, F.lit("    return 1"),
                    F.when(k % 4 == 2, F.concat(F.lit(NL + "    more_"), own, F.lit("()"))).otherwise(F.lit("")))
    head = F.when(k % 5 == 0, F.lit("import math")).when(k % 5 == 1, F.lit("import QISKIT")).otherwise(
        F.lit("import qiskit"))
    return _parts(spark, sf_dir).select(
        F.concat(F.lit("org/"), F.lower(F.regexp_replace("p_brand", "#", ""))).alias("repo"),
        F.concat(F.lit("part_"), k.cast("string"), F.lit(".py")).alias("path"),
        F.when(k % 11 == 0, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.concat(head, F.lit(NL + NL + NL), code, F.lit(NL)).alias("content"))
