import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from sigspark.llm import centroids as C
from sigspark.llm.queries import QUERIES, ORACLES

SF = "/root/testdata/sf0.01"


def plain(rows, dims=64, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"2:{r[0]}".encode()).hexdigest())
    cs = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        cs = [[sum(col) // len(m) for col in zip(*m)] if (m := [v for (_, v), o in zip(kept, own) if o == j]) else c for j, c in enumerate(cs)]
    return {i: (*near(v)[::-1], hashlib.sha256(",".join(map(str, cs[near(v)[1]])).encode()).hexdigest()) for i, v in kept}


def test_query_against_loops(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in e.collect()])
    got = QUERIES["op13_lookup_centroids"](spark, SF).collect()
    assert {r.vec_id: (r.cluster, r.distance, r.centroid_sha256) for r in got} == want
    assert all(r.inertia == sum(w[1] for w in want.values()) for r in got)
    for r in got:
        assert r.cluster_inertia == sum(w[1] for w in want.values() if w[0] == r.cluster)
    assert "op13_lookup_centroids" in ORACLES


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    v = [[float(x) for x in rng.normal(size=4)] for _ in range(6)]
    rows = [(1, v[0]), (1, v[0]), (1, v[1]), (None, v[2]), (2, v[3]), (3, None), (4, v[4][:3]), (5, [1.0, None, 0.0, 0.0]), (6, [1.0, float("nan"), 0.0, 0.0]),
            (7, [1.0, float("inf"), 0.0, 0.0]), (8, [1e30, 0.0, 0.0, 0.0]), (9, []), (10, v[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("v", F.lit(1)).withColumn("distance", F.lit(1))
    got = C.cluster(df, dimensions=4, clusters=3, rounds=2).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 1), (False, 2), (False, 10), (True, 0)]
    again = C.cluster(df.repartition(7), dimensions=4, clusters=3, rounds=2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    few = C.cluster(df, dimensions=4, clusters=50, rounds=1).collect()
    assert all(r.distance == 0 for r in few)
    assert C.cluster(df.limit(0), dimensions=4).count() == 0
    assert C.cluster(df.where("vec_id = 3"), dimensions=4).count() == 0


def test_ties_and_one_hot_vector(spark):
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 > 0, F.array(F.lit(0.5), F.lit(-0.25))).otherwise(
        F.array((F.col("id") % 7) / 8, F.lit(0.0))).alias("embedding"))
    got = {r.vec_id: r.cluster for r in C.cluster(df, dimensions=2, clusters=5, rounds=3).collect()}
    want = plain([(r.vec_id, r.embedding) for r in df.collect()], 2, 5, 3)
    assert got == {i: w[0] for i, w in want.items()}
