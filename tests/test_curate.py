"""curate() end to end on a handful of files."""

from corpusforge.plans.curate import curate
from corpusforge.plans.score import score

A = '''import qiskit


def build(n):
    """Make a thing."""
    x = n + 1
    return x


def test_build():
    assert build(1) == 2
'''
B = '''import qiskit


def build(n):
    """Make a thing."""
    x = n + 1
    return x


def other(values):
    total = 0
    for v in values:
        total = total + v
    return total
'''
C = "def unrelated(a):\n    return a * 2 + 1\n"          # no keyword: filtered out
D = "import qiskit\nprint 'old'\n"                         # keyword, does not parse


def test_curate_end_to_end(spark):
    files = spark.createDataFrame(
        [("o/a", "a.py", 200, A), ("o/b", "b.py", 200, B), ("o/c", "c.py", 200, C),
         ("o/d", "d.py", 200, D), ("o/e", "e.py", 404, A)],
        "repo string, path string, status int, content string")
    cur = curate(files)
    tasks = sorted(cur.tasks.collect(), key=lambda r: r["task_no"])
    # numbered before dedup: a.py build=0, b.py build=1 (exact copy, dropped), b.py other=2
    assert [(r["task_id"], r["entry_point"]) for r in tasks] == \
           [("qiskitHumanEval/0", "build"), ("qiskitHumanEval/2", "other")]
    assert tasks[0]["prompt"] == "# Make a thing.\n\n# Implement `build` below."
    assert tasks[0]["difficulty_scale"] == "basic"
    assert tasks[1]["difficulty_scale"] == "intermediate"
    prefs = cur.preferences.collect()
    assert {r["rejected"] for r in prefs} == {"# Incomplete or incorrect version\npass"}
    assert sorted(r["chosen"] for r in prefs) == sorted(r["canonical_solution"] for r in tasks)
    assert {r["difficulty_scale"]: r["count"] for r in cur.difficulty.collect()} == \
           {"basic": 1, "intermediate": 1}
    assert [(r["path"], r["status"]) for r in cur.quarantine.collect()] == [("d.py", "syntax_error")]


def test_score_pairs_by_task_id(spark):
    tasks = spark.createDataFrame([("t/1", "def f(n):\n    return n"), ("t/2", "")],
                                  "task_id string, canonical_solution string")
    good = "<reasoning>r</reasoning>\n<answer>import qiskit\ndef f(n):\n    return n</answer>"
    comps = spark.createDataFrame([("M", "t/2", good), ("M", "t/9", good), ("M", "t/1", good)],
                                  "model string, task_id string, text string")
    meas = spark.createDataFrame([("M", t, True, True, True, True, 0.64, 1, 1) for t in ("t/1", "t/2", "t/9")],
                                 "model string, task_id string, has_circuit boolean, sv_ok boolean, "
                                 "counts_ok boolean, ref_ok boolean, fidelity double, depth int, gates int")
    got = {r["task_id"]: r for r in score(comps, tasks, meas).collect()}
    assert got["t/1"]["r_fidelity"] == 1.6            # own reference
    assert got["t/2"]["r_fidelity"] == 0.0            # empty reference
    assert got["t/9"]["r_fidelity"] == 0.0            # no task at all
    assert all(got[t]["r_format"] == 1.0 and got[t]["r_import"] == 1.0 for t in got)


def test_curate_variant(spark):
    files = spark.createDataFrame([("o/a", "a.py", 200, A)],
                                  "repo string, path string, status int, content string")
    row = curate(files, variant=True).tasks.first()
    assert row["prompt"] == "# Make a thing.\n\n# Implement function `build` below."
    assert row["test"] == "def check(candidate):\n    # TODO: write tests for `build`\n    pass\n"
