"""Exact quantiles by range refinement against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.operators import quantiles
from corpusforge.operators.report import box_stats

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def columns():
    rng = random.Random(1)
    inf = float("inf")
    return {
        "even": [rng.random() for _ in range(700)],
        "ints": [float(rng.randrange(50)) for _ in range(500)],
        "tail": [math.exp(rng.gauss(0, 40)) for _ in range(600)],           # 1e-50 to 1e50
        "both": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)] + [0.0] * 9,
        "ends": [-inf, -1e308, -5e-324, 0.0, 5e-324, 1.0, 1e308, inf, inf],
        "near": [1 + i * 2.0 ** -52 for i in range(300)],
        "ties": [7.5] * 90 + [8.0], "one": [3.0], "none": [None, float("nan")]}


@pytest.mark.parametrize("bins", [4096, 3])
def test_exact_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    names = list(columns()) if bins > 3 else ["even", "ints", "ties", "one", "none"]
    rows = [(g, x) for g in names for x in columns()[g]] + [("even", None), ("even", float("nan")), (None, 5.0)]
    random.Random(2).shuffle(rows)
    got = {r.g: (r.n, r.q) for r in quantiles.exact_quantiles(
        spark.createDataFrame(rows, "g string, x double"), "x", "g", PROBS).collect()}
    assert set(got) == set(names) - {"none"}
    for g, (n, q) in got.items():
        data = sorted(columns()[g])
        assert n == len(data)
        for p, v in zip(PROBS, q):
            at = (n - 1) * p
            lo, hi = data[math.floor(at)], data[math.ceil(at)]
            want = lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))
            assert v == want or math.isnan(v) and math.isnan(want), (g, p)     # between infinities


def test_rounds_stay_few(spark, monkeypatch):
    """Values of 600 powers of ten need no more than seven rounds."""
    rounds = []
    cut = quantiles.cut_lineage
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    rng = random.Random(3)
    df = spark.createDataFrame([("a", 10.0 ** rng.uniform(-300, 300)) for _ in range(3000)], "g string, x double")
    quantiles.exact_quantiles(df, "x", "g", [0.1, 0.5]).collect()
    assert len(rounds) - 1 <= 7         # one written table a round, one before


def test_box_and_empty(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.normal(size=400), 9.0, -8.0]
    got = box_stats(spark.createDataFrame([("a", float(v)) for v in x], "g string, x double"), "x", "g").first()
    q1, med, q3 = np.percentile(x, [25, 50, 75])
    assert got[1:4] == pytest.approx((q1, med, q3))
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert got[4:] == pytest.approx((inside.min(), inside.max(), len(x) - len(inside)))
    none = spark.createDataFrame([], "g string, x double")
    assert box_stats(none, "x", "g").collect() == []
    assert quantiles.exact_quantiles(none.withColumn("x", F.col("x").cast("int")), "x", "g", [0.5]).collect() == []
