import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from sigspark.llm import periodic as P
from sigspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def plain(w, least=12):
    """Every lag, every maximal stretch of matches; of equal stretches the smallest period."""
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = p
        while i < len(w):
            if w[i] != w[i - p]:
                i += 1
                continue
            first = i
            while i < len(w) and w[i] == w[i - p]:
                i += 1
            if i - first >= p and i - first + p >= least:
                out.setdefault((first - p, i), p)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def codes(w):
    return np.array(w, np.int64)


def test_random_words_against_every_lag():
    rng = random.Random(5)
    for trial in range(400):
        n, letters = rng.randrange(1, 160), rng.choice([1, 2, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(n)]
        if trial % 3 == 0:
            a, p = rng.randrange(n), rng.randrange(1, 30)
            for i in range(a, n):
                w[i] = w[a + (i - a) % p] if i >= a + p else w[i]
        assert P.runs(codes(w)) == plain(w), w


def test_fixed_shapes():
    a, b = [0], [1]
    fibonacci = [a, a + b]
    for _ in range(12):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for w in (fibonacci[-1], (a * 40 + b) * 30, (a * 5 + b) * 9 + (a * 7 + b) * 8, (list(range(60)) + a * 70) * 4, [0, 1, 0, 1, 0] * 2 * 6,
              list(range(400)) * 2, list(range(400)) * 2 + [7] * 900 + list(range(399)) * 3, (list(range(50)) + list(range(50))) * 3 + [9]):
        assert P.runs(codes(w)) == plain(w)
    assert P.runs(codes([])) == [] and P.runs(codes([3])) == []
    assert P.runs(codes(a * 11)) == [] and P.runs(codes(a * 12)) == [(0, 12, 1)]


def test_very_long_texts():
    assert P.runs(codes([0] * 300_000)) == [(0, 300_000, 1)]
    assert P.runs(codes(list(range(5000)) * 40)) == [(0, 200_000, 5000)]
    assert P.runs(codes([1, 2, 3, 4, 5, 6, 7] * 20_000 + list(range(100_000)))) == [(0, 140_000, 7)]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a b " * 9), (4, "x"), (4, "x"), (5, "é " * 13 + "\x0b tail\x85end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("c"))
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in P.find(df).collect())
    assert got == sorted([("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("None", 18, [(0, 18, 2)], "a b"), ("4", 1, [], "x"), ("4", 1, [], "x"),
                          ("5", 14, [(0, 13, 1)], "é tail\x85end")])
    assert P.find(df.limit(0)).count() == 0


def test_query_against_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op12_diagonal_runs"](spark, SF).collect()}
    assert len(got) == len(docs) and "op12_diagonal_runs" in ORACLES
    rng = random.Random(1)
    for d in rng.sample(docs, 150):
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        if n > 1500:
            continue
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        number = {}
        r = plain([number.setdefault(x, len(number)) for x in w])
        drop = {i for s, m, p in r for i in range(s + p, s + m)}
        x = got[d.doc_id]
        assert x.n_runs == len(r)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in r).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(v for i, v in enumerate(w) if i not in drop).encode()).hexdigest()
        best = min(r, key=lambda t: (-t[1], t[0], t[2]), default=(None,) * 3)
        assert (x.start, x.length, x.period) == best
        assert x.exponent_milli == (None if best[0] is None else 1000 * best[1] // best[2])
