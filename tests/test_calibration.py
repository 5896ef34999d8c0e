"""Isotonic fits of any number of scores."""

import numpy as np
from pyspark.sql import functions as F

from sigspark.operators import calibration as C


def test_many_unrounded_scores_and_ranges(spark):
    rng = np.random.default_rng(1)
    x = rng.random(20_000)
    y = (rng.random(20_000) < x).astype(int)
    df = spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(x, y)], "k string, s double, y int").repartition(8)
    order = np.argsort(x)
    want = C.pool_violators(y[order].astype(float), np.ones(len(x)))
    for size in (1 << 16, 700):
        got = C.isotonic_fit(df, ["k"], "s", "y", size).orderBy("x").collect()
        assert [r.x for r in got] == x[order].tolist()
        assert np.allclose([r.y for r in got], want)


def test_ties_and_empty(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("a", 0.7, 0), ("b", 0.1, 1)], "k string, s double, y int")
    got = {(r.k, r.x): r.y for r in C.isotonic_fit(df, ["k"], "s", "y").collect()}
    assert got[("a", 0.5)] == got[("a", 0.7)] and abs(got[("a", 0.5)] - 1 / 3) < 1e-12 and got[("b", 0.1)] == 1.0
    assert C.isotonic_fit(df.where(F.lit(False)), ["k"], "s", "y").count() == 0
