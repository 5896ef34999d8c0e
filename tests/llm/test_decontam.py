import random
import re

import pytest
from pyspark.sql import functions as F

from sigspark.llm import decontam as D
from tests.llm.brute import ascii_lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(ascii_lower(t or ""))


def brute(docs, items, window=13):
    out = []
    wins = []
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        wins += [(i, tuple(w[k:k + n])) for k in range(len(w) - n + 1)] if n else []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    if i is not None:
                        ids.add(i)
        out.append((d, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=str)


def case():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 12, 13, 14, 30]))) for i in range(10)]
    items += [(20, "x x x x x x x x x x x x x x x x"), (21, None), (22, ""), (None, "null id words here are five or more of them now and again twice"), (3, text(20)), (23, "Été ça-va 12")]
    docs = []
    for d in range(40):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(items)[1] or ""
            w = t.split()
            parts += [" ".join(w[:rng.randint(0, len(w))]) if rng.random() < 0.3 else t.upper() if rng.random() < 0.3 else t, text(rng.randint(0, 10))]
        docs.append((d, ", ".join(parts)))
    docs += [(40, None), (41, ""), (42, "x " * 3000), (43, "..."), (None, "Null id words here are five or more of them now and again TWICE!"), (0, docs[0][1])]
    return docs, items


@pytest.mark.parametrize("block", [D.BLOCK_BYTES, 150])
def test_against_all_windows(spark, block):
    docs, items = case()
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    r = D.occurrences(d, b, block_bytes=block).collect()
    assert sorted(((x.doc_id, x.n_words, x.n_hit, tuple(x["items"])) for x in r), key=str) == brute(docs, items)
    assert all(sum(s.end - s.start for s in x.spans) == x.n_hit for x in r)
    bad = {str(i) for i, n, h, _ in brute(docs, items) if h and 20 * h >= n}
    kept = D.without_contaminated(d, b, block_bytes=block)
    assert kept.columns == d.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(i) for i, _ in docs if str(i) not in bad)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(x.n_words, x.n_hit) for x in D.occurrences(d, b).collect()] == [(3, 0)]
    assert D.occurrences(d.limit(0), b).count() == 0 and D.without_contaminated(d, b).count() == 1
    assert D.without_contaminated(d.limit(0), d.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
