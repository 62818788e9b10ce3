"""P2-P4, C1, C2 golden rows (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from corpusforge.operators.extract import (extract_function_rows, quarantined_files,
                                           valid_functions)
from corpusforge.operators.tasks import difficulty

MODULE = '''import os


def top(a, b):
    """Add two numbers."""
    def inner(x):
        return x + 1
    return inner(a) + b


class K:
    def method(self, value):
        return value * 2


if os.name:
    def conditional(a):
        return a - 1


@decorator
def decorated(q):
    return q * q * q


async def coro(z):
    return await z
'''


def _files(spark, rows):
    return spark.createDataFrame(rows, "repo string, path string, content string")


def test_column_zero_functions_only(spark):
    fns = extract_function_rows(_files(spark, [("r", "m.py", MODULE)]))
    valid = valid_functions(fns).orderBy("fn_ord").collect()
    assert [r["name"] for r in valid] == ["top", "decorated"]
    deco = valid[1]
    assert deco["code"] == "def decorated(q):\n    return q * q * q"
    assert "@decorator" not in deco["code"]
    assert valid[0]["docstring"] == "Add two numbers."
    # nested, method and conditional ones are extracted but fail on their own
    names = {r["name"]: r["snippet_parses"] for r in fns.collect()}
    assert names["inner"] is False and names["method"] is False and names["conditional"] is False
    assert "coro" not in names


def test_short_snippet_rule(spark):
    f25 = "def f():\n return 12345678"     # 25 characters
    f26 = "def f():\n return 123456789"    # 26 characters
    assert len(f25) == 25 and len(f26) == 26
    fns = extract_function_rows(_files(spark, [("r", "a.py", f25), ("r", "b.py", f26)]))
    assert [r["path"] for r in valid_functions(fns).collect()] == ["b.py"]


def test_test_names(spark):
    src = "def test_x(a):\n    return a + 1\n\n\ndef tester(a):\n    return a + 1\n"
    rows = valid_functions(extract_function_rows(_files(spark, [("r", "t.py", src)]))).collect()
    assert [r["name"] for r in rows] == ["tester"]


def test_unparsable_files_are_quarantined(spark):
    files = _files(spark, [("r", "py2.py", "print 'x'\n"), ("r", "nul.py", "def f():\x00\n    pass\n"),
                           ("r", "ok.py", "def good(a, b):\n    return a + b\n")])
    fns = extract_function_rows(files)
    assert [r["name"] for r in valid_functions(fns).collect()] == ["good"]
    bad = {r["path"]: r["status"] for r in quarantined_files(fns).collect()}
    assert set(bad) == {"py2.py", "nul.py"}
    assert all(v != "ok" for v in bad.values())


def test_counts_and_difficulty_edges(spark):
    cases = [(5, 2, 0, "basic"), (6, 0, 0, "intermediate"), (15, 2, 0, "intermediate"),
             (16, 2, 0, "advanced"), (16, 3, 0, "intermediate"), (2, 0, 1, "intermediate"),
             (None, None, None, "unknown")]
    df = spark.createDataFrame(cases, "s int, c int, b int, want string")
    got = df.select("want", difficulty("s", "c", "b").alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_syntax_counts(spark):
    src = ("def f(n):\n    x = 1\n    x += 1\n    y: int = 2\n    if n:\n        print(n)\n"
           "    for i in range(n):\n        pass\n    try:\n        g()\n    except E:\n        pass\n"
           "    return x\n")
    r = valid_functions(extract_function_rows(_files(spark, [("r", "c.py", src)]))).first()
    # Assign, If, For, FunctionDef, Return (not AugAssign / AnnAssign)
    assert r["num_stmts"] == 5
    assert r["num_calls"] == 3
    assert r["num_branches"] == 3


def test_indented_snippets_never_parse_and_form_feed_is_not_indent(spark):
    from corpusforge.functions.pyast import extract_functions
    src = ("class K:\n    def method(self, value):\n        return value * 2\n\n"
           "\x0cdef after_form_feed(a, b):\n    return a + b + 1\n")
    status, rows = extract_functions(src)
    got = {r[2]: r[5] for r in rows}
    assert status == "ok"
    assert got == {"method": False, "after_form_feed": True}
    # the shortcut agrees with a real parse of the snippet
    import ast
    for r in rows:
        try:
            ast.parse(r[3]); ok = True
        except SyntaxError:
            ok = False
        assert ok == r[5]


def test_tasks_and_batches_stay_small(spark, monkeypatch):
    import pyarrow as pa

    from corpusforge.operators import extract
    monkeypatch.setattr(extract, "FILES", 20)
    files = _files(spark, [("r", f"{i}.py", MODULE) for i in range(1000)])
    fns = extract_function_rows(files)
    assert fns.rdd.getNumPartitions() >= 50       # not one task a core, whatever the files
    assert fns.count() == 5000
    batch = pa.RecordBatch.from_pylist([{"repo": "r", "path": "p", "content": MODULE}] * 1000)
    out = list(extract._extract_batches(iter([batch])))
    assert max(b.num_rows for b in out) <= 5 * extract.STEP and sum(b.num_rows for b in out) == 5000


def test_functions_equal_their_text_parsed_alone():
    import ast

    from corpusforge.functions.pyast import extract_functions, node_counts
    body = "    return call(1) if a else 'aaaaaaaaaaaaaaa'"
    for text in (f"@d(1)\ndef f(a):\n{body}\n", f"def f(a):\n{body} \\\n\n", f"def f(a):\n{body}  # é \\\n",
f"def f(a):\r\n{body}\r\n", f"\x0cdef f(a):\n{body}\n"):
        (row,) = extract_functions(text)[1]
        try:
            alone = ast.parse(row[3])
        except SyntaxError:
            assert row[5:] == (False, None, None, None)
        else:
            assert row[5:] == (True, *node_counts(alone))


def test_files_are_built_after_the_rows_are_dealt_out(spark, tmp_path, monkeypatch):
    from corpusforge.plans import derived
    monkeypatch.setattr(derived, "FILES", 10)
    (spark.range(500).coalesce(1).selectExpr(
        "id as p_partkey", "'n' as p_name", "1 as p_size", "'Brand#1' as p_brand", "'T' as p_type")
     .write.parquet(str(tmp_path / "part.parquet")))
    for files in (derived.part_files, derived.copied_files):
        out = files(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() >= 50 and out.count() == 500
