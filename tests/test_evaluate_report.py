"""E1-E5 and V1-V3 golden rows."""

import numpy as np

from corpusforge.operators import evaluate as ev
from corpusforge.operators import report


def test_bround_half_even(spark):
    df = spark.createDataFrame([("m", 1, 1, 0.0625, 3)],
                               "model string, compile_success int, sim_success int, fidelity double, depth int")
    s = ev.summarise(df.withColumn("task_id", df.model)).first()
    assert s["mean_fidelity"] == 0.062


def test_all_missing_fidelity_group_kept(spark):
    rows = [("A", "t1", 1, 1, None, 2), ("A", "t2", 0, 0, None, None),
            ("B", "t3", 1, 0, 0.5, 4), (None, "t4", 1, 1, 0.1, 1), ("B", None, 1, 1, float("nan"), 6)]
    df = spark.createDataFrame(rows, "model string, task_id string, compile_success int, "
                                     "sim_success int, fidelity double, depth int")
    df = df.withColumn("fidelity", __import__("pyspark.sql.functions", fromlist=["nullif"])
                       .nullif("fidelity", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(float("nan"))))
    out = {r["model"]: r for r in ev.summarise(df).collect()}
    assert set(out) == {"A", "B"}
    assert out["A"]["mean_fidelity"] is None
    assert out["A"]["compile_rate"] == 0.5
    assert out["A"]["median_depth"] == 2.0
    assert out["B"]["count"] == 1          # NULL task ids are not counted
    assert out["B"]["median_depth"] == 5.0


def test_outcome_defaults(spark):
    comps = spark.createDataFrame(
        [("M", "t1", "code", None, "", "sol"), ("M", "t2", None, None, "ref", None),
         ("M", "t3", "code", None, None, None), ("M", "t4", "code", None, "r", None)],
        "model string, task_id string, generated_code string, completion string, "
        "reference string, canonical_solution string")
    meas = spark.createDataFrame(
        [("M", "t1", True, True, True, 0.9, 3), ("M", "t2", True, True, True, 0.9, 3),
         ("M", "t3", True, True, True, 0.9, 5), ("M", "t4", False, False, True, None, None)],
        "model string, task_id string, has_circuit boolean, sv_ok boolean, ref_ok boolean, "
        "fidelity double, depth int")
    o = {r["task_id"]: r for r in ev.outcome_rows(comps, meas).collect()}
    assert (o["t1"]["compile_success"], o["t1"]["sim_success"], o["t1"]["fidelity"], o["t1"]["depth"]) == (1, 1, 0.9, 3)
    assert (o["t2"]["compile_success"], o["t2"]["fidelity"]) == (0, None)      # empty code
    assert (o["t3"]["compile_success"], o["t3"]["fidelity"]) == (1, None)      # no reference text
    assert (o["t4"]["compile_success"], o["t4"]["sim_success"], o["t4"]["depth"]) == (0, 0, None)


def test_histogram_matches_numpy(spark):
    vals = [k / 100 for k in range(101)]
    df = spark.createDataFrame([("m", v) for v in vals], "model string, x double")
    got = {r["bin"]: r["count"] for r in report.histogram(df, "x", "model", 20).collect()}
    counts, edges = np.histogram(vals, bins=20)
    assert [got.get(i, 0) for i in range(20)] == list(counts)
    const = spark.createDataFrame([("m", 0.3)] * 5, "model string, x double")
    rows = report.histogram(const, "x", "model", 20).collect()
    c2, e2 = np.histogram([0.3] * 5, bins=20)
    assert [(r["bin"], r["count"]) for r in rows] == [(int(np.argmax(c2)), 5)]
    assert abs(rows[0]["bin_lo"] - e2[int(np.argmax(c2))]) < 1e-12


def _box_numpy(x, whis=1.5):
    x = np.asarray(x, float)
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    iqr = q3 - q1
    hi = x[x <= q3 + whis * iqr]
    lo = x[x >= q1 - whis * iqr]
    whi = q3 if len(hi) == 0 or hi.max() < q3 else hi.max()
    wlo = q1 if len(lo) == 0 or lo.min() > q1 else lo.min()
    return q1, med, q3, wlo, whi, int(((x < wlo) | (x > whi)).sum())


def test_box_stats(spark):
    data = {"A": [1, 2, 2, 3, 4, 5, 40], "B": [7, 7, 7, 7]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "model string, depth int")
    got = {r["model"]: r for r in report.box_stats(df, "depth", "model").collect()}
    for k, vs in data.items():
        q1, med, q3, wlo, whi, nout = _box_numpy(vs)
        r = got[k]
        assert (r["q1"], r["median"], r["q3"], r["whisker_lo"], r["whisker_hi"], r["n_outliers"]) == \
               (q1, med, q3, wlo, whi, nout)


def test_rates_long(spark):
    s = spark.createDataFrame([("A", 0.5, 0.25)], "model string, compile_rate double, sim_rate double")
    rows = sorted(tuple(r) for r in report.rates_long(s).collect())
    assert rows == [("A", "compile_rate", 0.5), ("A", "sim_rate", 0.25)]


def test_box_outliers_rows(spark):
    data = {"A": [1, 2, 2, 3, 4, 5, 40], "B": [7, 7, 7, 7, -50]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "model string, depth int")
    got = sorted(tuple(r) for r in report.box_outliers(df, "depth", "model").collect())
    want = []
    for k, vs in data.items():
        q1, med, q3, wlo, whi, nout = _box_numpy(vs)
        want += [(k, float(v)) for v in vs if v < wlo or v > whi]
    assert got == sorted(want)


def test_completion_ids_and_repeated_keys(spark):
    import pytest

    from corpusforge.operators.evaluate import outcome_rows
    c = spark.createDataFrame([("m", "t", i, "code", "ref") for i in (1, 2)],
                              "model string, task_id string, completion_id int, generated string, reference string")
    m = spark.createDataFrame([("m", "t", i, True, True, True, 0.5, i) for i in (1, 2)],
                              "model string, task_id string, completion_id int, has_circuit boolean, sv_ok boolean, "
                              "ref_ok boolean, fidelity double, depth int")
    from corpusforge.sources import schemas
    cols = [f.name for f in schemas.COMPLETIONS.fields]
    for name in cols:
        if name not in c.columns:
            from pyspark.sql import functions as F
            c = c.withColumn(name, F.lit("x"))
    got = outcome_rows(c, m).collect()
    assert sorted((r.completion_id, r.depth) for r in got) == [(1, 1), (2, 2)]
    with pytest.raises(ValueError):
        outcome_rows(c.drop("completion_id"), m.drop("completion_id"))


def test_rounding_and_nan(spark):
    from corpusforge.operators.evaluate import summarise
    from corpusforge.operators.report import box_stats
    o = spark.createDataFrame([("m", "t", 1, 1, 0.5015, 1)],
                              "model string, task_id string, compile_success int, sim_success int, fidelity double, depth int")
    assert summarise(o).first().mean_fidelity == 0.501
    b = box_stats(spark.createDataFrame([("m", float(x)) for x in (1, 2, 3)] + [("m", float("nan"))],
                                        "model string, v double"), "v", "model").first()
    assert (b.q1, b.q3, b.n_outliers) == (1.5, 2.5, 0)
