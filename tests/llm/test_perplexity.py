import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sigspark.llm import perplexity as X, text as T
from sigspark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"
WORD = r"[^\x20\x09-\x0D]+"


def plain_measures(t):
    t = t or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i:i + 3])].append(i)
    rep = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return [len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(rep)]


def plain_model(texts, order):
    """Textbook recursion over counted tuples of bytes."""
    units = [b" " + b" ".join(re.findall(WORD.encode(), t.encode())) if re.search(WORD, t) else b"" for t in texts]
    c = {order: Counter(u[i:i + order] for u in units for i in range(len(u) - order + 1))}
    for k in range(order - 1, 0, -1):
        c[k] = Counter(g[1:] for g in c[k + 1])
    cut = {}
    for k, t in c.items():
        n = [sum(v == i for v in t.values()) for i in (1, 2, 3, 4)]
        cut[k] = X.discounts(n)
    total, free = defaultdict(float), defaultdict(float)
    less = lambda k, v: cut[k][min(v, 3) - 1]
    for k, t in c.items():
        for g, v in t.items():
            total[k, g[:-1]] += v
            free[k, g[:-1]] += less(k, v)

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 1 / 256
        h = (k, g[:-1])
        return (c[k][g] - less(k, c[k][g])) / total[h] + free[h] / total[h] * lower

    out = []
    for u in units:
        gs = [u[i:i + order] for i in range(len(u) - order + 1)]
        letters = sum(T.ALNUM[g[-1]] for g in gs)
        out.append(-sum(math.log(p(g)) for g in gs) / max(1, letters) if gs else None)
    return out


TEXTS = ["the cat sat on the mat. the cat sat on the hat", "", "a", "été été * été | x\ny\n\ny\n y", "the hat sat\ton  the cat!!", "ab " * 300, " \n ", "zz"]


def test_measures_against_loops(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()]
    got = X.measures(*T.flat(pa.array(TEXTS + [None] + docs)))
    assert got.tolist() == [plain_measures(t) for t in TEXTS + [None] + docs]
    assert X.measures(*T.flat(pa.array([], pa.string()))).shape == (0, 5)


@pytest.mark.parametrize("order", [2, 5])
def test_model_against_textbook(spark, order):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("lang", F.lit("xx")).repartition(3)
    got = {r.doc_id: r.log_perplexity for r in X.judge(df, order=order).collect()}
    for i, v in enumerate(plain_model(TEXTS, order)):
        assert (got[i] is None) == (v is None) and (v is None or abs(got[i] - v) < 1e-5)


def test_probabilities_add_up(spark):
    """After every context that is followed by all bytes seen anywhere, what is left goes to unseen bytes only."""
    df = spark.createDataFrame([("abracadabra",), ("abba cab",)], "text string")
    m = X.model(X.counts(df, 3), 3).collect()
    by = defaultdict(float)
    for r in m:
        assert 0 < r.p < 1
        by[r.gram >> 8] += r.p
    assert all(v < 1 for v in by.values())


def test_ranges_from_the_folder_equal_the_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    full = X.written(X.counts(docs), "counts")
    monkeypatch.setattr(X, "RANGE", 1 << 12)
    n = full.count()
    arrays = X.stored(X.model(full), n)
    assert arrays.count() > 4
    a = X.scored(docs, arrays, n, ["doc_id"], 1 << 26).toPandas()
    b = X.scored(docs, arrays, n, ["doc_id"], 0).toPandas()
    assert a.equals(b)


def test_tasks_that_send_early_count_the_same(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(100)
    a, b = (sorted(map(tuple, X.counts(docs, hold=h).collect())) for h in (X.HOLD, 1000))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", None), (None, "word " * 60, None), (3, "x y z " * 40, "en"), (3, "x y z " * 40, "en"), (4, "###", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit(1)).withColumn("gram", F.lit("g")).withColumn("lower", F.lit(2))
    got = X.judge(df).collect()
    assert len(got) == 6 and all(r.base_failed and not r.kept for r in got)  # all are short or repeat themselves
    assert X.judge(df.limit(0)).count() == 0


def test_bands_reject_both_sides(spark):
    rng = np.random.default_rng(2)
    syllables = ["ta", "ri", "mo", "len", "su", "kar", "po", "vi", "den", "sha"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    clean = [" ".join(word() for _ in range(200)) for _ in range(120)]
    noise = ["".join(map(chr, rng.integers(97, 123, 5))) for _ in range(200)]
    marked = " ".join(word() + "***" for _ in range(200))
    easy = " ".join("ta" * int(k) for k in rng.permutation(np.arange(2, 80)))
    rows = [(i, t, "en") for i, t in enumerate([*clean, " ".join(noise), marked, easy])]
    got = {r.doc_id: r for r in X.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(120))
    assert not got[120].kept and got[120].log_perplexity > got[120].upper
    assert not got[121].kept and not got[121].base_failed
    assert not got[122].kept and got[122].log_perplexity < got[122].lower


def test_query_on_labelled_documents(spark):
    r = QUERIES["op11_perplexity_bands"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    r = r[~r.base_failed]
    assert r[r.quality == 1].kept.mean() > 0.98 and r[r.quality == 0].kept.mean() < 0.15
    assert "op11_perplexity_bands" in ORACLES
