"""Registered queries: one per inventory group, each over whole shared tables
(or data Spark derives from them). Each takes ``(spark, sf_dir)`` and
returns a DataFrame; ``oracle.py`` holds the matching DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.functions.rewards import prepare
from corpusforge.operators import evaluate as ev
from corpusforge.operators import report
from corpusforge.operators.dedup import exact_dedup, near_dedup
from corpusforge.operators.extract import (extract_function_rows, quarantined_files,
                                           valid_functions)
from corpusforge.operators.quantiles import exact_quantiles
from corpusforge.operators.formats import chat_rows, instruction_rows
from corpusforge.operators.tasks import (REJECTED, difficulty, difficulty_counts, keyword_filter,
                                         number_functions, preference_rows, task_rows)
from corpusforge.plans import derived as dv
from corpusforge.plans.curate import curate
from corpusforge.plans.score import score
from corpusforge.session import cut_lineage, scratch_path
from corpusforge.sources import readers as rd
from corpusforge.sources import schemas
from corpusforge.sources import writers as wr

EOS = "</s>"
# Fixed rows appended to `documents` for the chain case (threshold 0.95,
# 20 tokens): row 2 shares 19 of its 20 tokens with row 1, row 3 shares 19
# with row 2 but 18 with row 1, so greedy drops row 2 and keeps row 3.
CHAIN_BASE_ID = 1_000_000_000


def chain_rows() -> list[tuple[int, str]]:
    a = [f"chaintok{i:02d}" for i in range(1, 21)]
    r1 = a
    r2 = a[1:] + ["chainnew01"]
    r3 = a[2:] + ["chainnew01", "chainnew02"]
    return [(CHAIN_BASE_ID + i, " ".join(r)) for i, r in enumerate((r1, r2, r3), 1)]


# ---- dedup ---------------------------------------------------------------------

def q_dedup_exact(spark, sf):
    d = dv.table(spark, sf, "documents")
    return exact_dedup(d, "doc_id", "text").select("doc_id")


def q_dedup_near(spark, sf):
    d = dv.table(spark, sf, "documents")
    return near_dedup(d, "doc_id", "text", 0.95).select("doc_id", "lang", "source", "n_chars")


def q_dedup_near_chain(spark, sf):
    d = dv.table(spark, sf, "documents").select("doc_id", "text")
    extra = spark.createDataFrame(chain_rows(), "doc_id long, text string")
    return near_dedup(d.unionByName(extra), "doc_id", "text", 0.95).select("doc_id")


# ---- listing, names, scan, keyword -----------------------------------------------

def _document_pages(spark, sf):
    d = dv.table(spark, sf, "documents")
    item = F.struct(
        F.col("doc_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.struct(F.concat_ws("/", "source", "lang").alias("full_name"),
                 F.lit("main").alias("default_branch")).alias("repository"))
    pages = (d.select((F.floor(F.col("doc_id") / 100) + 1).cast("int").alias("page"), item.alias("it"))
             .groupBy("page").agg(F.sort_array(F.collect_list("it")).alias("its")))
    return pages.select("page", F.lit(200).alias("status"),
                        F.transform("its", lambda x: F.struct(x["path"].alias("path"),
                                                              x["repository"].alias("repository"))).alias("items"))


def q_listing(spark, sf):
    items = rd.listing(_document_pages(spark, sf), max_files=None, per_page=100)
    return items.select("page", "pos", "path", "repo", "branch",
                        rd.raw_url("repo", "branch", "path").alias("url"))


def q_listing_stops(spark, sf):
    """The stop rules: a failed, a missing and a short page, no first page, a cap."""
    pages = _document_pages(spark, sf)
    page = F.col("page")
    runs = {
        "failed": pages.withColumn("status", F.when(page % 7 == 2, 500).otherwise(200)),
        "missing": pages.where(page % 8 != 3),
        "short": pages.withColumn("items", F.when(page % 6 == 2, F.slice("items", 1, 60)).otherwise(F.col("items"))),
        "no_first": pages.where(page != 1)}
    out = [rd.listing(p).withColumn("run", F.lit(r)) for r, p in runs.items()]
    out.append(rd.listing(pages, max_files=150).withColumn("run", F.lit("capped")))
    return ev.stack(*out).select("run", "page", "pos", "path")


def q_flat_names(spark, sf):
    p = dv.table(spark, sf, "pages")
    repo = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/(.*)$", 1)
    return p.select("page_id", repo.alias("repo"), path.alias("path"),
                    rd.flat_name(repo, path).alias("flat_name"))


def q_scan_files(spark, sf):
    d = dv.table(spark, sf, "documents")
    raw = F.encode("text", "UTF-8")
    crlf = F.encode(F.regexp_replace("text", "\n", "\r\n"), "UTF-8")
    content = (F.when(F.col("doc_id") % 7 == 3, F.concat(raw, F.unhex(F.lit("FF"))))
               .when(F.col("doc_id") % 3 == 1, crlf).otherwise(raw))
    files = d.select("doc_id", content.alias("content"))
    return rd.decode_source(files).select("doc_id", "content")


def q_keyword_filter(spark, sf):
    d = dv.table(spark, sf, "documents")
    files = d.select("doc_id", F.when(F.col("doc_id") % 10 == 9, 404).otherwise(200).alias("status"),
                     F.col("text").alias("content"))
    return keyword_filter(files, "the").select("doc_id")


# ---- extraction, grading, tasks ------------------------------------------------

def _valid(spark, sf):
    return valid_functions(extract_function_rows(dv.part_files(spark, sf)))


def q_extract_functions(spark, sf):
    return _valid(spark, sf).select("repo", "path", "fn_ord", "lineno", "name")


def q_difficulty(spark, sf):
    return _valid(spark, sf).select(
        "repo", "path", "name", "num_stmts", "num_calls", "num_branches",
        difficulty("num_stmts", "num_calls", "num_branches").alias("difficulty_scale"))


def _tasks(spark, sf, variant=False):
    return task_rows(number_functions(_valid(spark, sf)), variant=variant)


def q_difficulty_counts(spark, sf):
    return difficulty_counts(_tasks(spark, sf))


def q_task_rows(spark, sf):
    return _tasks(spark, sf)


def q_task_rows_variant(spark, sf):
    return _tasks(spark, sf, variant=True)


def q_curated_tasks(spark, sf):
    cur = curate(dv.part_files(spark, sf), keyword=None)
    return cur.tasks.select("task_id", "entry_point", "difficulty_scale")


def _curated_copies(spark, sf):
    return curate(dv.copied_files(spark, sf))


def q_curated_copies(spark, sf):
    """P1 to D2 over files with exact and near copies."""
    return _curated_copies(spark, sf).tasks.select("task_id", "entry_point", "difficulty_scale")


def q_difficulty_kept(spark, sf):
    """E6 over what the deduplication keeps."""
    return _curated_copies(spark, sf).difficulty


def q_quarantine_files(spark, sf):
    fns = extract_function_rows(dv.part_files(spark, sf))
    return quarantined_files(fns).select("repo", "path")


def q_preference_rows(spark, sf):
    return preference_rows(dv.document_tasks(spark, sf))


def q_instruction_rows(spark, sf):
    return instruction_rows(preference_rows(dv.document_tasks(spark, sf)), EOS)


def q_chat_rows(spark, sf):
    c = chat_rows(dv.document_tasks(spark, sf), keep=("doc_id",))
    return c.select("doc_id",
                    F.col("prompt")[0]["role"].alias("system_role"),
                    F.col("prompt")[0]["content"].alias("system_content"),
                    F.col("prompt")[1]["role"].alias("user_role"),
                    F.col("prompt")[1]["content"].alias("user_content"),
                    "reference")


# ---- round trips -----------------------------------------------------------------

def q_roundtrip_json(spark, sf):
    d = dv.table(spark, sf, "documents")
    path = scratch_path(spark, "roundtrip-json")
    wr.write_tasks_json(d, path)
    return spark.read.schema(d.schema).json(path)


def q_roundtrip_array(spark, sf):
    """S5 and S6 as one JSON array in pieces that many tasks write and read."""
    d = dv.table(spark, sf, "documents")
    path = scratch_path(spark, "roundtrip-array")
    wr.write_array(d, path, ["doc_id"])
    back = rd.read_array_elements(spark, path, parts=True)
    return back.select(F.from_json("element", d.schema).alias("r")).select("r.*")


def q_read_tasks_array(spark, sf):
    """Pretty-printed arrays of a hundred tasks, one per file."""
    d = dv.document_tasks(spark, sf)
    cols = schemas.TASKS.names
    path = scratch_path(spark, "tasks-array")
    arrays = (d.groupBy(F.floor(F.col("doc_id") / 100).alias("part"))
              .agg(F.to_json(F.collect_list(F.struct(*cols)), {"pretty": "true"}).alias("value")))
    arrays.write.partitionBy("part").text(path)
    return rd.read_tasks_json(spark, path, multiline=True).select(*cols)


def q_roundtrip_csv(spark, sf):
    d = dv.table(spark, sf, "documents")
    k = F.col("doc_id") % 5
    chosen = (F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("    "), "text", F.lit("  ")))
              .when(k == 2, F.concat(F.lit('say "hi"\\'), "text", F.lit("\r\n\tend")))
              .otherwise(F.col("text")))
    prefs = d.select(F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("prompt"),
                     chosen.alias("chosen"), F.lit(REJECTED).alias("rejected"))
    path = scratch_path(spark, "roundtrip-csv")
    wr.write_preferences_csv(prefs, path)
    return rd.read_preferences_csv(spark, path)


# ---- completion checks and rewards ---------------------------------------------

def q_answers(spark, sf):
    p = prepare(dv.completion_texts(spark, sf))
    return p.select("conv_id", "turn", "answer", "xml_ok")


def q_format_reward(spark, sf):
    from corpusforge.functions.rewards import r_format
    p = prepare(dv.completion_texts(spark, sf))
    return p.select("conv_id", "turn", "struct_reason", r_format(p).alias("r_format"))


def q_import_reward(spark, sf):
    from corpusforge.functions.rewards import r_import
    p = prepare(dv.completion_texts(spark, sf))
    return p.select("conv_id", "turn", "import_reason", r_import(p).alias("r_import"))


def q_reward_generations(spark, sf):
    """R7-R10 with two completions of each task."""
    comp = dv.generations(dv.completion_texts(spark, sf))
    meas = dv.generations(dv.measurements(spark, sf))
    s = score(comp, dv.document_tasks(spark, sf), meas)
    return s.select("model", "task_id", "completion_id", "r_format", "r_import", "r_run",
                    F.bround("r_fidelity", 9).alias("r_fidelity"), F.bround("r_size", 9).alias("r_size"))


def q_run_rewards(spark, sf):
    from corpusforge.functions.rewards import r_fidelity, r_run, r_size
    m = dv.measurements(spark, sf).withColumn("struct_reason", F.lit("ok"))
    return m.select("model", "task_id", r_run(m).alias("r_run"),
                    F.bround(r_fidelity(m), 9).alias("r_fidelity"),
                    F.bround(r_size(m), 9).alias("r_size"))


def q_reward_table(spark, sf):
    comp = dv.completion_texts(spark, sf)
    s = score(comp, dv.document_tasks(spark, sf), dv.measurements(spark, sf))
    return s.select("model", "task_id", "r_format", "r_import", "r_run",
                    F.bround("r_fidelity", 9).alias("r_fidelity"),
                    F.bround("r_size", 9).alias("r_size"))


# ---- evaluation ------------------------------------------------------------------

def _write_completion_files(spark, sf) -> str:
    path = scratch_path(spark, "completions")
    dv.completion_records(spark, sf).write.partitionBy("model").text(path)
    return path


def _read_model_files(spark, path):
    frames = []
    for model in ("GRPO", "ORPO"):
        df = rd.read_completions(spark, f"{path}/model={model}")
        frames.append(ev.tag_model(df, model))
    return ev.stack(*frames)


def q_read_completions(spark, sf):
    recs = _read_model_files(spark, _write_completion_files(spark, sf))
    good, _ = ev.split_bad_rows(recs, F.col("_corrupt_record").isNotNull())
    return good.select("model", "task_id", ev.completion_text().alias("code"),
                       ev.reference_text().alias("ref"))


def _outcomes(spark, sf):
    recs = _read_model_files(spark, _write_completion_files(spark, sf))
    good, _ = ev.split_bad_rows(recs, F.col("_corrupt_record").isNotNull())
    return ev.outcome_rows(good, dv.measurements(spark, sf))


def _read_arrays(spark, sf):
    """S9 and E2 on array files, some of them cut short: good rows, bad rows."""
    path = scratch_path(spark, "completion-arrays")
    dv.completion_arrays(spark, sf).write.partitionBy("model", "file").text(path)
    frames = [ev.tag_model(rd.read_completions(spark, f"{path}/model={m}", multiline=True), m)
              for m in ("GRPO", "ORPO")]
    return ev.split_bad_rows(ev.stack(*frames), F.col("_corrupt_record").isNotNull())


def q_read_completions_array(spark, sf):
    good, _ = _read_arrays(spark, sf)
    return good.select("model", "task_id", ev.completion_text().alias("code"), ev.reference_text().alias("ref"))


def q_quarantine_completions(spark, sf):
    _, bad = _read_arrays(spark, sf)
    return bad.select("model", F.trim(F.col("_corrupt_record")).alias("raw"))


def q_outcomes_generations(spark, sf):
    """E1 with two completions of each task, told apart by ``completion_id``."""
    path = scratch_path(spark, "generations")
    lines = dv.completion_records(spark, sf)
    rec = F.from_json("value", schemas.COMPLETIONS)
    made = (lines.select("model", "value", rec.alias("r")).where("r.task_id is not null")
            .select("model", "r.*").drop("completion_id"))
    dv.generations(made).write.partitionBy("model").json(path)
    return ev.outcome_rows(_read_model_files(spark, path), dv.generations(dv.measurements(spark, sf)))


def q_outcomes_detail(spark, sf):
    """The detail table, written and read with awkward ids."""
    t = F.col("task_id")
    k = F.split(t, "/")[1].cast("long") % 5
    odd = (F.when(k == 0, F.concat(F.lit(" "), t, F.lit(" "))).when(k == 1, F.concat(F.lit('a"b,'), t))
           .when(k == 2, F.concat(t, F.lit("\r\nx"))).when(k == 3, F.lit("")).otherwise(t))
    path = scratch_path(spark, "detail")
    wr.write_outcomes_csv(_outcomes(spark, sf).withColumn("task_id", odd), path)
    return rd.read_outcomes_csv(spark, path).drop("completion_id")


def q_outcomes(spark, sf):
    return _outcomes(spark, sf)


def q_model_summary(spark, sf):
    return ev.summarise(_outcomes(spark, sf))


def q_rates_long(spark, sf):
    path = scratch_path(spark, "summary")
    wr.write_summary_csv(ev.summarise(_outcomes(spark, sf)), path)
    return report.rates_long(rd.read_summary_csv(spark, path))


def q_fidelity_hist(spark, sf):
    o = cut_lineage(_outcomes(spark, sf).select("model", "fidelity"))
    return report.histogram(o, "fidelity", "model", 20)


def q_depth_box(spark, sf):
    o = cut_lineage(_outcomes(spark, sf).select("model", "depth"))   # two passes over it
    return report.box_stats(o, "depth", "model")


def q_value_box(spark, sf):
    """V3 over a continuous column."""
    return report.box_stats(dv.table(spark, sf, "events"), "value", "event_type")


def q_value_outliers(spark, sf):
    return report.box_outliers(dv.table(spark, sf, "events"), "value", "event_type")


def q_price_quantiles(spark, sf):
    """Exact tails of a continuous column: 1 %, 10 %, 50 %, 90 %, 99 %."""
    q = exact_quantiles(dv.table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", [0.01, 0.1, 0.5, 0.9, 0.99])
    return q.select("l_returnflag", "n", *[F.bround(F.col("q")[i], 6).alias(c)
                                           for i, c in enumerate(("p01", "p10", "p50", "p90", "p99"))])


QUERIES = {
    "dedup_exact": q_dedup_exact,
    "dedup_near": q_dedup_near,
    "dedup_near_chain": q_dedup_near_chain,
    "listing": q_listing,
    "listing_stops": q_listing_stops,
    "flat_names": q_flat_names,
    "scan_files": q_scan_files,
    "keyword_filter": q_keyword_filter,
    "extract_functions": q_extract_functions,
    "difficulty": q_difficulty,
    "difficulty_counts": q_difficulty_counts,
    "task_rows": q_task_rows,
    "task_rows_variant": q_task_rows_variant,
    "curated_tasks": q_curated_tasks,
    "curated_copies": q_curated_copies,
    "difficulty_kept": q_difficulty_kept,
    "quarantine_files": q_quarantine_files,
    "preference_rows": q_preference_rows,
    "instruction_rows": q_instruction_rows,
    "chat_rows": q_chat_rows,
    "roundtrip_json": q_roundtrip_json,
    "roundtrip_array": q_roundtrip_array,
    "read_tasks_array": q_read_tasks_array,
    "roundtrip_csv": q_roundtrip_csv,
    "answers": q_answers,
    "format_reward": q_format_reward,
    "import_reward": q_import_reward,
    "run_rewards": q_run_rewards,
    "reward_table": q_reward_table,
    "reward_generations": q_reward_generations,
    "read_completions": q_read_completions,
    "read_completions_array": q_read_completions_array,
    "quarantine_completions": q_quarantine_completions,
    "outcomes": q_outcomes,
    "outcomes_generations": q_outcomes_generations,
    "outcomes_detail": q_outcomes_detail,
    "model_summary": q_model_summary,
    "rates_long": q_rates_long,
    "fidelity_hist": q_fidelity_hist,
    "depth_box": q_depth_box,
    "value_box": q_value_box,
    "value_outliers": q_value_outliers,
    "price_quantiles": q_price_quantiles,
}
