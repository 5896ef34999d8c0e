"""Two levels of a key: the same as a plain loop, and no task holds the joins of all rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import pulses as P, symbols as L


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(3)
    rows = [(k, n, float(v)) for k in range(5) for n, v in enumerate(rng.normal(0, 0.4, 60) + (rng.random(60) < 0.3 + 0.1 * k) * 3)]
    return rows, spark.createDataFrame(rows, "k2 long, k long, y double")


def test_rounds_are_not_in_one_plan(values):
    _, df = values
    start = df.groupBy("k2").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    levels = P.two_level_threshold(df, ["k2"], "y", start, rounds=6)
    assert "Join" not in levels._jdf.queryExecution().optimizedPlan().toString()
    bits, c = L.demap_ask(df, ["k2"], "y", least=0.0, rounds=4)
    assert bits._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3


def test_levels_equal_a_plain_loop(values):
    rows, df = values
    start = df.groupBy("k2").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    got = {r.k2: (r.lo, r.hi) for r in P.two_level_threshold(df, ["k2"], "y", start, rounds=4).collect()}
    for k in range(5):
        y = np.array([r[2] for r in rows if r[0] == k])
        lo, hi = y.min(), y.max()
        for _ in range(4):
            low = y <= (lo + hi) / 2
            lo, hi = y[low].mean(), y[~low].mean()
        assert got[k] == pytest.approx((lo, hi))


def test_registered_demap_runs_all_rounds(spark, tmp_path):
    """The registered query and its SQL fit the levels as long as the operator does, not for fewer rounds."""
    import duckdb
    from sigspark.plans import load
    rng = np.random.default_rng(11)
    vec = np.exp(rng.normal(0, 0.6, (300, 64)))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    from sigspark.plans import q_decisions as Q
    symbols = Q._dump(spark, str(tmp_path)).toPandas()
    want, moved = {}, 0
    for key, g in symbols.groupby(["capture_id", "blk"]):
        y, steps = g["y"].to_numpy(), []
        lo, hi = y.min(), y.max()
        for _ in range(10):
            low = y <= (lo + hi) / 2
            lo, hi = y[low].mean(), y[~low].mean()
            steps.append((lo, hi))
        moved += steps[3] != steps[-1]
        bit = y > (lo + hi) / 2
        want[key] = (max(0, 1 - np.where(bit, abs(y - hi), abs(y - lo)).mean() / ((hi - lo) / 2)), int(bit.sum()))
    assert moved
    found = load()
    got = {(r.capture_id, r.blk): r for r in found.QUERIES["demap_ask"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    twin = {r[:2]: r[2:] for r in con.execute(found.ORACLES["demap_ask"]).fetchall()}
    assert set(got) == set(want) == set(twin)
    for key, (confidence, ones) in want.items():
        r = got[key]
        assert (r.confidence, r.ones) == pytest.approx((confidence, ones), abs=2e-6) if r.decoded else confidence < 0.4
        assert twin[key] == pytest.approx((r.confidence, r.decoded, r.ones), abs=2e-6)


def test_a_key_of_one_value_is_declined(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0), (2, 0, 0.0), (2, 1, 4.0), (3, 0, None)], "k2 long, k long, y double")
    bits, c = L.demap_ask(df, ["k2"], "y")
    assert {(r.k2, r.confidence, r.decoded) for r in c.collect()} == {(1, None, False), (2, 1.0, True), (3, None, False)}
    assert sorted((r.k2, r.k, r.bit) for r in bits.collect()) == [(2, 0, 0), (2, 1, 1)]
