"""Task, preference and grading operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.numbering import global_index
from corpusforge.session import cut_lineage

# Fixed values (must equal the reference output byte for byte).
TASK_PREFIX = "qiskitHumanEval"
KEYWORD = "qiskit"
PROMPT_MAIN = ("# ", "\n\n# Implement `", "` below.")
PROMPT_VARIANT = ("# ", "\n\n# Implement function `", "` below.")
TEST_TEMPLATE = ("def check(candidate):\n    # TODO: write tests for `", "`\n    pass\n")
REJECTED = "# Incomplete or incorrect version\npass"
DIFFICULTY_LEVELS = ("basic", "intermediate", "advanced", "unknown")


def keyword_filter(files: DataFrame, keyword: str = KEYWORD,
                   content_col: str = "content", status_col: str = "status") -> DataFrame:
    """Fetch succeeded and the lower-cased text contains the keyword."""
    return files.where((F.col(status_col) == 200)
                       & F.lower(F.col(content_col)).contains(keyword.lower()))


def difficulty(stmts, calls, branches) -> Column:
    """C2 over the C1 counts; NULL counts (parse failure) -> ``unknown``."""
    s, c, b = (F.col(x) if isinstance(x, str) else x for x in (stmts, calls, branches))
    return (F.when(s.isNull() | c.isNull() | b.isNull(), F.lit("unknown"))
            .when((s <= 5) & (c <= 2) & (b == 0), F.lit("basic"))
            .when(((s > 5) & (s <= 15)) | (c > 2) | (b > 0), F.lit("intermediate"))
            .otherwise(F.lit("advanced")))


def number_functions(valid: DataFrame, prefix: str = TASK_PREFIX,
                     order_cols=("repo", "path", "fn_ord"), materialize: bool = True) -> DataFrame:
    """P5: 0-based running number over valid functions in a total order,
    assigned before dedup; ``task_id = prefix/n``. The input (the output of
    the Python extraction pass) is materialised once so the range sampling
    and the shuffle do not parse the files again (skip when the caller
    already materialised it)."""
    out = global_index(cut_lineage(valid) if materialize else valid, list(order_cols), "task_no")
    return out.withColumn("task_id", F.concat(F.lit(prefix + "/"), F.col("task_no").cast("string")))


def _prompt(parts) -> Column:
    return F.concat(F.lit(parts[0]), F.coalesce(F.col("docstring"), F.lit("")),
                    F.lit(parts[1]), F.col("name"), F.lit(parts[2]))


def task_rows(numbered: DataFrame, variant: bool = False, keep_order: bool = False) -> DataFrame:
    """P6-P8 (+C2): the task record. ``variant`` adds the placeholder test
    and the other prompt wording. ``keep_order`` keeps ``task_no``."""
    cols = [F.col("task_id"),
            _prompt(PROMPT_VARIANT if variant else PROMPT_MAIN).alias("prompt"),
            F.col("code").alias("canonical_solution")]
    if variant:
        cols.append(F.concat(F.lit(TEST_TEMPLATE[0]), F.col("name"),
                             F.lit(TEST_TEMPLATE[1])).alias("test"))
    cols += [F.col("name").alias("entry_point"),
             difficulty("num_stmts", "num_calls", "num_branches").alias("difficulty_scale")]
    if keep_order:
        cols.append(F.col("task_no"))
    return numbered.select(*cols)


def preference_rows(tasks: DataFrame, rejected: str = REJECTED) -> DataFrame:
    """``(prompt, chosen=solution, rejected=constant)``."""
    return tasks.select("prompt", F.col("canonical_solution").alias("chosen"),
                        F.lit(rejected).alias("rejected"))


def difficulty_counts(tasks: DataFrame) -> DataFrame:
    """Rows per difficulty label (hash aggregate, partial + final)."""
    return tasks.groupBy("difficulty_scale").agg(F.count(F.lit(1)).alias("count"))
