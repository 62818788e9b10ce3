"""Completion checks and reward columns.

Every reward is a ``Column`` builder over one scored frame; the only Python
step is the structure parse (R3), an Arrow-batched pandas UDF evaluated
once per completion and shared by all rewards. Run outcomes (circuit built,
simulations succeeded, fidelity, depth, gates) are measured elsewhere and
arrive as columns; nothing is executed here.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from corpusforge.functions.pyast import function_shape
from corpusforge.functions.text import PY_WS, py_strip
from corpusforge.session import ship_package

# Fixed values (must equal the reference's checks).
BANNED_SUBSTRINGS = ("os.system", "subprocess", "sys.exit", "open(", "requests.", "socket.")
IMPORT_MODULE = "qiskit"
DEPRECATED_IMPORTS = ("from {m} import Aer", "{m}.Aer")
REASONS = ("syntax_error", "must_contain_exactly_one_function_def", "banned_calls", "ok")
IMPORT_REASONS = ("qiskit_import_ok", "missing_qiskit_import", "deprecated_aer_import")
IMPORT_SCORES = {"ok": 1.0, "missing": 0.2, "deprecated": 0.0}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def xml_ok(text) -> Column:
    """``<reasoning>…</reasoning>`` then whitespace then
    ``<answer>…</answer>`` anywhere in the text, dot matching newline."""
    pat = f"(?s)<reasoning>.*?</reasoning>{PY_WS}*<answer>.*?</answer>"
    return F.coalesce(_c(text).rlike(pat), F.lit(False))


def extract_answer(text) -> Column:
    """R2: text between the first ``<answer>`` and the next ``</answer>``
    (or the next ``<answer>`` / the end), stripped; ``''`` without a tag."""
    after = F.coalesce(F.get(F.split(_c(text), "<answer>"), 1), F.lit(""))
    return py_strip(F.substring_index(after, "</answer>", 1))


@F.pandas_udf(StructType([StructField("parses", BooleanType()),
                           StructField("n_functions", IntegerType())]))
def _shape_udf(src: pd.Series) -> pd.DataFrame:
    shapes = [function_shape(s) if s is not None else (False, 0) for s in src]
    return pd.DataFrame(shapes, columns=["parses", "n_functions"])


def function_shape_col(src) -> Column:
    """R3 parse half as a struct ``(parses, n_functions)``."""
    return _shape_udf(_c(src))


def banned(src) -> Column:
    s = _c(src)
    return reduce(lambda a, b: a | b, [s.contains(b) for b in BANNED_SUBSTRINGS])


def structure_reason(shape, src) -> Column:
    """R3 reason, in the reference's order of tests."""
    sh = _c(shape)
    return (F.when(~sh["parses"], F.lit(REASONS[0]))
            .when(sh["n_functions"] != 1, F.lit(REASONS[1]))
            .when(banned(src), F.lit(REASONS[2]))
            .otherwise(F.lit(REASONS[3])))


def import_reason(src, module: str = IMPORT_MODULE) -> Column:
    """Case-sensitive substring tests."""
    s = _c(src)
    has = s.contains(f"import {module}") | s.contains(f"from {module}")
    dep = reduce(lambda a, b: a | b, [s.contains(d.format(m=module)) for d in DEPRECATED_IMPORTS])
    return (F.when(has & dep, F.lit("deprecated_aer_import"))
            .when(has, F.lit(f"{module}_import_ok"))
            .otherwise(F.lit(f"missing_{module}_import")))


# ---- rewards over a prepared frame -----------------------------------------
# The prepared frame has: answer, xml_ok, struct_reason, import_reason and the
# measured columns has_circuit, sv_ok, counts_ok, fidelity, depth, gates.

def r_format(df: DataFrame) -> Column:
    """0.5 * container + 0.5 * structure ok."""
    return (0.5 * F.col("xml_ok").cast("double")
            + 0.5 * (F.col("struct_reason") == "ok").cast("double"))


def r_import(df: DataFrame) -> Column:
    """1.0 ok, 0.2 missing, 0.0 deprecated."""
    r = F.col("import_reason")
    return (F.when(r.endswith("_import_ok"), F.lit(IMPORT_SCORES["ok"]))
            .when(r.startswith("missing_"), F.lit(IMPORT_SCORES["missing"]))
            .otherwise(F.lit(IMPORT_SCORES["deprecated"])))


def _ran() -> Column:
    return (F.col("struct_reason") == "ok") & F.coalesce(F.col("has_circuit"), F.lit(False))


def r_run(df: DataFrame) -> Column:
    """0 unless the structure is ok and a circuit was built; then
    1.0 * statevector ok + 0.5 * counts ok."""
    return F.when(_ran(), F.coalesce(F.col("sv_ok"), F.lit(False)).cast("double")
                  + 0.5 * F.coalesce(F.col("counts_ok"), F.lit(False)).cast("double")
                  ).otherwise(F.lit(0.0))


def r_fidelity(df: DataFrame) -> Column:
    """2 * sqrt(fidelity); 0 when either side failed (fidelity NULL or NaN)."""
    ok = _ran() & F.coalesce(F.col("sv_ok"), F.lit(False)) & F.coalesce(F.col("ref_ok"), F.lit(False))
    return F.coalesce(F.when(ok, 2.0 * F.sqrt(F.nullif(F.col("fidelity"), F.lit(float("nan"))))), F.lit(0.0))


def r_size(df: DataFrame) -> Column:
    """1 / (1 + ln(1+depth) + 0.5 ln(1+gates)); zero depth or gates
    count as 1; 0 without a circuit."""
    d = F.when(F.coalesce(F.col("depth"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("depth"))
    g = F.when(F.coalesce(F.col("gates"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("gates"))
    return F.when(_ran(), 1.0 / (1.0 + F.log1p(d) + 0.5 * F.log1p(g))).otherwise(F.lit(0.0))


# Ordered registry, name -> builder. Extend with register_reward().
REWARDS: dict[str, Callable[[DataFrame], Column]] = {
    "format": r_format,
    "import": r_import,
    "run": r_run,
    "fidelity": r_fidelity,
    "size": r_size,
}


def register_reward(name: str, builder: Callable[[DataFrame], Column]) -> None:
    REWARDS[name] = builder


def prepare(completions: DataFrame, text_col: str = "text",
            module: str = IMPORT_MODULE) -> DataFrame:
    """R1-R3, R5 once per completion: answer, container flag, structure and
    import reasons. The parse UDF runs once (struct column, then fields)."""
    ship_package(completions.sparkSession)
    ans = completions.withColumn("answer", extract_answer(text_col)) \
                     .withColumn("xml_ok", xml_ok(text_col))
    ans = ans.withColumn("_shape", function_shape_col("answer"))
    return (ans.withColumn("struct_reason", structure_reason("_shape", "answer"))
            .withColumn("import_reason", import_reason("answer", module))
            .drop("_shape"))


def reward_columns(prepared: DataFrame, names=None) -> list[Column]:
    names = list(REWARDS) if names is None else list(names)
    return [REWARDS[n](prepared).alias(f"r_{n}") for n in names]
