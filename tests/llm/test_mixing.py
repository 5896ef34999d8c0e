import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sigspark.llm import mixing as M

SF = "/root/testdata/sf0.01"


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_ = {}, set(order)
    while open_:
        rest = sum(sizes.values()) - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= cap * sizes[s]}
        if not over:
            return out | share
        out |= {s: cap * sizes[s] for s in over}
        open_ -= over
    return out


def check(rows, texts):
    by, want = defaultdict(int), defaultdict(int)
    for r in rows:
        want[r.source] += r["size"]
        by[r.source] += r.copies * r["size"]
        assert 0 <= r.copies <= 3
    goal = brute_targets(dict(want))
    smallest = defaultdict(lambda: 1 << 60)
    for r in rows:
        assert r.source_size == want[r.source] and r.target == pytest.approx(goal[r.source], abs=1e-6)
        smallest[r.source] = min(smallest[r.source], r["size"] or 1 << 60)
    for s in want:
        assert abs(by[s] - goal[s]) <= max(0.02 * goal[s], smallest[s]), s  # whole copies of the smallest documents settle the rest


def test_real_sources(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = M.mix(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(r["size"] == size(texts[r.doc_id]) for r in rows)
    check(rows, texts)
    again = {r.doc_id: r.copies for r in M.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    out = M.mixed(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in out} == {d: c for d, c in again.items() if c}


def test_hot_source_small_sources_nulls(spark):
    rows = [(i, "w " * (1 + i % 40), "big") for i in range(900)] + [(1000 + i, "a b c", "Z") for i in range(3)] + [(2000 + i, "x " * 9, None) for i in range(50)]
    rows += [(3000, None, "empty"), (3001, "", "empty"), (None, "n n n", "Z"), (5, "w w", "big"), (4000, "y " * 30_000, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit(1), "copies": F.lit("k")})
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    check(got, None)
    assert M.mixed(docs).columns == docs.columns
    assert M.mix(docs.limit(0)).count() == 0 and M.mixed(docs.limit(0)).count() == 0


def test_rates_solve_the_dual(spark):
    cells = spark.createDataFrame([("a", 10, 5), ("a", 100, 2), ("b", 7, 9)], "source string, size long, n long")
    goals = spark.createDataFrame([("a", 250, 300.0), ("b", 63, 20.0)], "source string, source_size long, target double")
    r = {x.source: x for x in M.balance(cells, goals).collect()}
    import math
    got = sum(s * n * min(3, math.exp(r["a"].lam * s / r["a"]["mean"])) for s, n in ((10, 5), (100, 2)))
    assert got == pytest.approx(300, rel=1e-6)
    assert 63 * math.exp(r["b"].lam) == pytest.approx(20, rel=1e-6)


def test_mixed_writes_what_mix_takes_without_ids(spark):
    """Null and repeated ids over several sources and sizes, and rows that are equal in every column."""
    import random
    rng = random.Random(4)
    rows = [(rng.choice([None, None, 1, 2, i]), " ".join("w" * rng.randrange(1, 6) for _ in range(rng.choice([3, 3, 8, 20, 50]))), rng.choice(["a", "b", "c", None]))
            for i in range(300)] + [(7, "same text here", "a")] * 40 + [(None, None, "b")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    m = M.mix(df).collect()
    taken = {}
    for r in m:
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
    got = {}
    out = M.mixed(df).collect()
    for r in out:
        got[r.source] = got.get(r.source, 0) + len((r.text or "").split())
    assert got == {k: v for k, v in taken.items()}
    assert len(out) == sum(r.copies for r in m)
