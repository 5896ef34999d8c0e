import numpy as np
import pandas as pd
import pytest

from sigspark.operators import partitioning as P
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def hot():
    """One key holds most rows; values repeat, are negative, tiny and huge."""
    r = np.random.default_rng(1)
    k = np.where(r.random(4000) < 0.7, 0, r.integers(1, 6, 4000))
    v = np.where(r.random(4000) < 0.2, 3.25, r.normal(0, 1, 4000) * 10.0 ** r.integers(-6, 6, 4000))
    return pd.DataFrame({"k": k, "v": v})


def test_quantiles_match_numpy(spark, hot):
    got = {r.k: r for r in P.quantiles(spark.createDataFrame(hot), ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.95}).collect()}
    for k, g in hot.groupby("k"):
        assert np.allclose([got[k].a, got[k].m, got[k].z], np.percentile(g.v, [10, 50, 95]), rtol=1e-12)


def test_quantiles_without_keys(spark, hot):
    x = P.quantiles(spark.createDataFrame(hot), [], "v", {"m": 0.5}).first()
    assert np.isclose(x.m, np.median(hot.v))


def union(rows, gap):
    out = []
    for lo, hi in sorted(rows):
        if out and lo <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("block", [16, 1000, None])
@pytest.mark.parametrize("gap", [0, 3])
def test_merge_intervals_over_block_edges(spark, block, gap):
    r = np.random.default_rng(2)
    lo = r.integers(0, 3000, 500)
    df = pd.DataFrame({"k": np.where(np.arange(500) % 3 == 0, 1, 0), "lo": lo, "hi": lo + r.integers(1, 60, 500) ** r.integers(1, 3, 500) // 20 + 1})
    got = P.merge_intervals(spark.createDataFrame(df), ["k"], "lo", "hi", gap, block).orderBy("k", "lo").collect()
    want = [(k, *x) for k, g in df.groupby("k") for x in union(list(zip(g.lo, g.hi)), gap)]
    assert [(x.k, x.lo, x.hi) for x in got] == want
    assert sum(x.n for x in got) == 500


def test_prefix_sums(spark, hot):
    df = hot.reset_index().rename(columns={"index": "n"})
    s = P.prefix_sums(spark.createDataFrame(df).withColumn("b", F.floor(F.col("n") / 100)), ["k"], "b", ["n"], c=F.lit(1))
    got = s.orderBy("k", "n").toPandas()
    assert (got.groupby("k").c.apply(lambda x: list(x) == list(range(1, len(x) + 1)))).all()


def test_halo_window_equals_global_window(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("n"), (F.col("id") * 7 % 13).cast("double").alias("v"))
    h = P.halo(df, ["k"], "n", 64, 2, 3)
    w = P.halo_window(["k"], "n").rowsBetween(-2, 3)
    got = h.withColumn("m", F.sum("v").over(w)).where("core").orderBy("n").toPandas().m.to_numpy()
    v = (np.arange(5000) * 7 % 13).astype(float)
    want = [v[max(0, i - 2):i + 4].sum() for i in range(5000)]
    assert np.array_equal(got, want)


def test_point_in_interval(spark):
    pts = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("n"))
    iv = spark.createDataFrame([(1, 5, 6), (1, 90, 330), (1, 330, 331), (1, 999, 2000)], "k int, lo long, hi long")
    got = {(r.n, r.lo) for r in P.point_in_interval(pts, iv, ["k"], "n", "lo", "hi", 100).collect()}
    assert got == {(n, lo) for lo, hi in ((5, 6), (90, 330), (330, 331), (999, 2000)) for n in range(1000) if lo <= n < hi}


def test_quantiles_shuffle_a_value_once(spark):
    """Equal values meet as counts: no join sees the rows of a value that very many share."""
    x = spark.range(0, 200_000, 1, 4).select(F.lit("k").alias("k"), (F.col("id") % 9).cast("double").alias("v"))
    q = P.quantiles(x, ["k"], "v", {"m": 0.5})
    assert q.collect()[0].m == 4.0
    plan = q._jdf.queryExecution().optimizedPlan().toString().splitlines()
    for at in (k for k, line in enumerate(plan) if "Range" in line):
        assert next(w for line in reversed(plan[:at]) for w in ("Aggregate", "Join") if w in line) == "Aggregate"
