import random

import numpy as np
import pyarrow as pa
import pytest

from sigspark.llm import ngram_join as J, text as T
from tests.llm.brute import jaccard_components

SCHEMA = "doc_id long, text string, key string, n long, comp string"


def words(rng, n, v=4000):
    return [f"W{rng.randrange(v)}" for _ in range(n)]


def corpus(seed=3):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        texts.append(" ".join(words(rng, rng.randint(1, 60))))
    for _ in range(8):  # families around the threshold
        base = words(rng, 80)
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(80)] = f"E{rng.randrange(9999)}"
            texts.append(" ".join(w))
    base = words(rng, 120)
    for _ in range(60):  # a posting list beyond SMALL, not all linked with all
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(120)] = f"E{rng.randrange(9999)}"
        texts.append(" ".join(w))
    passage = words(rng, 30)
    for _ in range(50):  # a passage that many documents share
        texts.append(" ".join(words(rng, rng.randint(5, 30)) + passage))
    texts += ["", " \t\n", None, "one two", "ONE  two", "one two three", "a b c d e", "a b c d e f", "a b c d e f g"]
    texts += ["x " * 40, "x " * 41, "é ü " * 9 + "é", "É ü " * 9 + "É"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("small,leaf,tile", [(8, 32, 1 << 16), (3, 8, 40)])
def test_components_equal_all_pairs(spark, monkeypatch, small, leaf, tile):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "LEAF", leaf)
    monkeypatch.setattr(J, "TILE", tile)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k", 1, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == jaccard_components(rows)


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "p q r s t u"), (7, "zz"), (None, "lonely words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in J.near_duplicates(df).collect())
    assert got == sorted([(5, 2, 5), (5, 2, 5), (-1, 2, 5), (-1, 0, -1), (7, 2, 7), (7, 1, 7), (-1, 1, -1)])


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(df).count() == 0
    assert J.one_of_each(df).count() == 0


def test_one_of_each_keeps_one(spark):
    rows = [(3, "a b c d e f", "x"), (1, "a b c d e f", None), (2, "other words here", "y"), (1, "a b c d e f", None), (9, "", "z"), (None, "n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(((r.doc_id or -1), r.text, r.source) for r in J.one_of_each(df).collect())
    assert got == sorted([(1, "a b c d e f", None), (2, "other words here", "y"), (9, "", "z"), (-1, "n", "z")], key=lambda r: r[0])


def test_bound_never_below_overlap():
    import pyarrow as pa
    rng = random.Random(1)
    texts = [" ".join(words(rng, rng.randint(1, 200), 60)) for _ in range(40)]
    tokens, offs = T.shingle_sets(pa.array(texts))
    v = J.count_vectors(tokens, offs)
    b = J.bounds(v, v)
    for i in range(40):
        for j in range(40):
            assert b[i, j] >= len(np.intersect1d(tokens[offs[i]:offs[i + 1]], tokens[offs[j]:offs[j + 1]]))


def test_copies_send_one_request(spark):
    """Copies of a text cost a flush nothing, and what a set shares is counted without them."""
    rng = random.Random(8)
    base = words(rng, 200)
    a, b, c = " ".join(base), " ".join(base[:150] + words(rng, 50)), " ".join(words(rng, 120))
    texts = [a] * 400 + [b] * 30 + [c] * 50
    rng.shuffle(texts)

    def requests(rows):
        return J._probe_requests(spark.createDataFrame([(t,) for t in rows], "text string").coalesce(1), 5, J.PROBE, 1)

    sent = [sum(len(x) for row in requests(rows).collect() for x in row[1:]) for rows in (texts, [a, b, c])]
    assert sent[0] == sent[1]
    tokens, offs = T.shingle_sets(pa.array([a, b, c]))
    refs = np.maximum(T.set_keys(tokens, offs)[:, 0].astype(np.uint32), 1).tolist()
    low = [{int(t) for t in tokens[offs[i]:offs[i + 1]] if t < int(J.PROBE * (1 << T.TOKEN_BITS))} for i in range(3)]
    for buckets in (1, 7):
        got = {r.ref: r.shared for r in J.shared_counts(J._probe_requests(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), 5, J.PROBE, buckets), buckets).collect()}
        assert got == {refs[0]: len(low[0] & low[1]), refs[1]: len(low[0] & low[1])}


def test_one_row_of_each_component_whatever_the_ids(spark):
    """Null ids, one id over different texts, one text under several ids, and rows that are equal in every column."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    rows = [(5, a, 1), (5, b, 1), (None, a + " tail", 1), (None, c, 1), (None, c, 1), (7, c, 1), (8, b + " tail", 2), (9, "", 1), (9, "", 1), (None, None, 1),
            (10, "only one", 1), (10, "only one", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, best int").repartition(4)
    got = sorted(map(str, J.one_of_each(df).collect()))
    want = [(5, a, 1), (5, b, 1), (7, c, 1), (9, "", 1), (9, "", 1), (None, None, 1)]
    ones = [g for g in got if "only one" in g]
    assert len(ones) == 1
    assert sorted(g for g in got if "only one" not in g) == sorted(f"Row(doc_id={i}, text={t!r}, best={n})" for i, t, n in want)


def test_one_text_for_most_rows(spark):
    from pyspark.sql import functions as F
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"),
                                  F.when(F.col("id") % 3 > 0, F.lit(a)).otherwise(F.lit(b)).alias("text"))
    got = J.one_of_each(df).collect()
    assert sorted((r.doc_id, r.text[:2]) for r in got) == [(0, "b0"), (4, "a0")]
    assert J.near_duplicates(df).groupBy("component_id", "n_shingles").count().collect().__len__() == 2


def family_rows(spark, texts):
    tokens, offs = T.shingle_sets(pa.array(texts))
    keys = T.set_keys(tokens, offs)
    rows = [(bytearray(keys[i].tobytes()), bytearray(tokens[offs[i]:offs[i + 1]].tobytes())) for i in range(len(texts))]
    return spark.createDataFrame(rows, "key binary, tokens binary"), len(tokens)


def test_common_lines_make_no_long_lists(spark):
    """A line that is in every text comes last in the prefixes, so its lists do not hold the whole table."""
    rng = random.Random(4)
    line = words(rng, 12)
    texts = [" ".join(own + line + own[:8]) for own in (words(rng, 40, 10 ** 9) for _ in range(300))]
    family, total = family_rows(spark, texts)
    levels = J.token_levels(family, total)
    assert (levels == 8).sum() == 8  # the shingles inside the line are in 300 sets
    met = J.postings(family, 75, 3, spark.sparkContext.broadcast(levels)).collect()
    assert met == []


def test_trees_hold_the_sets_of_a_list(spark):
    """Lists that share no set are searched one by one: work grows with the lists, not with the square of all their sets."""
    rng = np.random.default_rng(5)
    compared = []
    for lists in (10, 40):
        m = lists * 32
        v = rng.integers(0, 9, (m, J.FINE_GROUPS)).astype(np.uint8)
        n = v.sum(1).astype(np.int64)
        of = np.repeat(np.arange(lists), 32)
        found = list(J._searched(of, np.arange(m), v, n, np.arange(m), np.zeros(m, np.int64), 10))
        assert all((of[i] == of[j]).all() for i, j, _ in found)
        compared.append(sum(len(i) for i, _, _ in found))
    assert compared == [10 * 32 * 31 // 2, 40 * 32 * 31 // 2]


def test_sides_and_one_tree_find_every_pair():
    rng = np.random.default_rng(6)
    m = 150
    v = rng.integers(0, 3, (m, J.FINE_GROUPS)).astype(np.uint8)
    n, comp, side = v.sum(1).astype(np.int64), rng.integers(0, 6, m), np.zeros(m, np.int64)
    lists, own = np.repeat(np.arange(4), m), np.tile(np.arange(m), 4)  # one tree serves equal lists
    for side in (side, rng.integers(0, 2, m)):
        want = {(i, j) for i in range(m) for j in range(i) if comp[i] != comp[j] and (side[i] != side[j] or not side.any())
                and J.within(np.minimum(v[i], v[j]).sum(dtype=np.int64), n[i], n[j], 33)}
        got = [(max(i, j), min(i, j)) for x, y, _ in J._searched(lists, own, v, n, comp, side, 33) for i, j in zip(x, y)]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_shared_slots_and_lists_in_parts_lose_no_link(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("LEAF", 8), ("TILE", 20), ("COMMON", 2), ("LEVEL_SLOTS", 32), ("HOT_LEVEL", 3)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(5)
    df = spark.createDataFrame([(i, t, "k", 1, None) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == jaccard_components(rows)


def test_one_of_each_with_lists_in_parts(spark, monkeypatch):
    for name, value in (("SMALL", 3), ("LEAF", 8), ("TILE", 20), ("COMMON", 2), ("LEVEL_SLOTS", 32), ("HOT_LEVEL", 3)):
        monkeypatch.setattr(J, name, value)
    rows = corpus(6)
    got = {r.doc_id for r in J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, (_, component) in jaccard_components(rows).items() if component == i}
