"""R1-R11 golden rows."""

import math

from pyspark.sql import functions as F

from corpusforge.functions.rewards import (extract_answer, prepare, r_fidelity, r_import,
                                           r_size, xml_ok)


def test_answer_extraction(spark):
    cases = [("abc", ""), ("p<answer> q", "q"), ("p<answer> q<answer>r", "q"),
             ("<answer>x</answer>", "x"), (None, "")]
    df = spark.createDataFrame(cases, "t string, want string")
    assert all(r[0] == r[1] for r in df.select(extract_answer("t"), "want").collect())


def test_container_match(spark):
    cases = [("<reasoning>a\nb</reasoning>\n <answer>x\n</answer>", True),
             ("<reasoning>a</reasoning>x<answer>b</answer>", False),
             ("pre <reasoning></reasoning><answer></answer> post", True),
             ("<answer>x</answer>", False)]
    df = spark.createDataFrame(cases, "t string, want boolean")
    assert all(r[0] == r[1] for r in df.select(xml_ok("t"), "want").collect())


def _prep(spark, answers):
    texts = [f"<reasoning>r</reasoning>\n<answer>{a}</answer>" for a in answers]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return prepare(df).orderBy("i")


def test_structure_reasons(spark):
    answers = ["def f(x):\n    return reopen(x)",       # banned substring (plain)
               "def f(x):\n    return x",
               "def f(x):\n    def g():\n        pass\n    return x",   # nested counts
               "def f(:",
               "x = 1",
               "async def f():\n    pass"]
    got = [r["struct_reason"] for r in _prep(spark, answers).collect()]
    assert got == ["banned_calls", "ok", "must_contain_exactly_one_function_def", "syntax_error",
                   "must_contain_exactly_one_function_def", "must_contain_exactly_one_function_def"]


def test_import_reward(spark):
    answers = ["import qiskit\ndef f():\n    pass", "def f():\n    pass",
               "from qiskit import Aer\ndef f():\n    pass"]
    p = _prep(spark, answers)
    got = [r[0] for r in p.select(r_import(p)).collect()]
    assert got == [1.0, 0.2, 0.0]


def test_size_and_fidelity_rewards(spark):
    df = spark.createDataFrame(
        [("ok", True, True, True, 0.25, 0, 0), ("ok", True, True, True, None, 3, 4),
         ("banned_calls", True, True, True, 0.25, 0, 0)],
        "struct_reason string, has_circuit boolean, sv_ok boolean, ref_ok boolean, "
        "fidelity double, depth int, gates int")
    rows = df.select(r_size(df).alias("s"), r_fidelity(df).alias("f")).collect()
    assert math.isclose(rows[0]["s"], 1 / (1 + math.log(2) + 0.5 * math.log(2)))
    assert rows[0]["f"] == 1.0
    assert rows[1]["f"] == 0.0
    assert math.isclose(rows[1]["s"], 1 / (1 + math.log1p(3) + 0.5 * math.log1p(4)))
    assert rows[2]["s"] == 0.0 and rows[2]["f"] == 0.0


def test_shape_udf_runs_once_per_row(spark):
    p = _prep(spark, ["def f():\n    pass"])
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
