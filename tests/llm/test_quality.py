import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sigspark.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_statistics_against_loops():
    texts = ["The CAT | sat, sat. 12", "", None, "a a a\nb!", "$$$ " * 50, "é" * 30]
    x = Q.statistics(pa.array(texts))
    for row, t in zip(x, texts):
        t = t or ""
        w, raw = t.lower().split(), t.encode()
        s = dict(zip(Q.STATS, row))
        n = max(1, len(w))
        assert np.isclose(s["log_words"], np.log1p(len(w)))
        assert np.isclose(s["upper"], sum(c.isascii() and c.isupper() for c in t) / max(1, len(raw)))
        assert np.isclose(s["bars"], t.count("|") / max(1, len(raw)))
        assert np.isclose(s["distinct_words"], len(set(w)) / n)
        assert np.isclose(s["repeats"], sum(a == b for a, b in zip(w, w[1:])) / n)
        assert np.isclose(s["word_length"], sum(len(v.encode()) for v in w) / n)


def test_rule_column_equals_rules(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, len(Q.STATS)))
    y = ((x[:, 0] > 0.4) & (x[:, 3] < 0.7) | (x[:, 5] > 0.9)).astype(float)
    m = Q.fit(x, y)
    assert 0 < len(m.rules) < 300 and all(len(r) <= Q.DEPTH for r in m.rules)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ",".join(f"{s} double" for s in Q.STATS)).select(F.struct("*").alias("q"))
    got = np.array([r[0] for r in df.select(m.column("q")).collect()])
    assert np.allclose(np.sort(got), np.sort(m.score(x)))


def test_held_out_accuracy_and_columns(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    r = Q.score(docs, labels).join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(r.doc_id, r.held_out))
    t = r[r.held_out]
    bad, good = t[t.quality == 0], t[t.quality == 1]
    assert (good.predicted == 1).mean() > 0.95 and (bad.score.mean() < good.score.mean() - 0.5)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, ""), (1, ""), (2, None), (None, "some words"), (3, "A!! " * 5000)], "doc_id long, text string")
    docs = docs.withColumn("quality", F.lit(1)).withColumn("stats", F.lit("s"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0), (9, 0, None)], "doc_id long, quality int, toxic int")
    for l in (labels, labels.limit(0)):
        got = Q.score(docs, l).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
        assert Q.accepted(docs, l).columns == docs.columns
    assert Q.score(docs.limit(0), labels).count() == 0
