"""Python whitespace semantics as column expressions (strip / split)."""

from pyspark.sql import functions as F

from corpusforge.functions.text import normalize_newlines, py_split, py_strip

SAMPLES = [
    "", " ", "a", " a ", "\n\ta b\x0b\x0c\r", "\x1c x \x1f", "\x85y\xa0", "　z ",
    "a b c", "  def f():\n    return 1\n\n", "​not-space​", "x y z",
]


def test_strip_and_split_match_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")
    rows = df.select("i", py_strip("s").alias("st"), py_split("s").alias("sp")).collect()
    for r in rows:
        assert r["st"] == SAMPLES[r["i"]].strip()
        assert list(r["sp"]) == SAMPLES[r["i"]].split()


def test_newline_normalisation(spark):
    df = spark.createDataFrame([("a\r\nb\rc\n",)], "s string")
    assert df.select(normalize_newlines("s")).first()[0] == "a\nb\nc\n"


def test_strip_is_linear(spark):
    import time

    from pyspark.sql import functions as F

    from corpusforge.functions.text import py_strip
    text = "a" + " " * 1_000_000 + "b "
    df = spark.createDataFrame([(text,)], "t string")
    t0 = time.time()
    assert df.select(F.length(py_strip("t"))).first()[0] == len(text) - 1
    assert time.time() - t0 < 20
