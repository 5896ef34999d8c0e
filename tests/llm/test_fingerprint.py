import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import fingerprint as P


def walk(text):
    """The embedding step by step."""
    codes, out = P._codes(text), []
    for b in range(0, len(codes), P.BLOCK):
        x, i = codes[b:b + P.BLOCK], 0
        for j in range(len(x) * P.STEPS):
            c = x[i] if i < len(x) else 0
            out.append(c)
            if i < len(x):
                i += int(P._WALK[j][c])
    return out


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gam", "é", "delta", "to", "of", "😀", "epsilon"]) + str(rng.randrange(30)) for _ in range(n))


def test_walk_and_sample():
    rng = random.Random(1)
    texts = ["", "a", "ab", words(rng, 30), words(rng, 400), words(rng, 90), "x" * 1100]
    for t, e in zip(texts, P.embed(texts)):
        assert e.tolist() == walk(t)
    for t, f in zip(texts, P.fingerprints(texts)):
        n, level, body = f.split(":")
        assert int(n) == len(t) and bytes.fromhex(body) == bytes(np.array(walk(t), np.uint8)[P.slots(len(t), int(level))].tobytes())


def test_small_edits_stay_near():
    rng = random.Random(2)
    near, far = [], []
    for _ in range(30):
        t, o = words(rng, 300), words(rng, 300)
        i = rng.randrange(len(t))
        a, b, c = P.fingerprints([t, t[:i] + "zq" + t[i:], o])
        near.append(P.likeness(a, b))
        far.append(P.likeness(a, c))
    assert np.mean(near) > 0.6 and np.mean(far) < 0.25 and min(near) > max(far)


def test_contract_columns(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([1, 3, 40, 300]))) for i in range(120)] + [(500, None), (501, ""), (502, "one"), (503, "same text"), (504, "same text"), (7, "another seven"), (None, "none")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit("k"), "fingerprint": F.lit(1)}).repartition(5)
    got = P.edit_test(df).collect()
    assert len(got) == len(rows)
    text = {i: t or "" for i, t in rows if i not in (7, None)}
    ids = sorted(text, reverse=True)
    fp = dict(zip(ids, P.fingerprints([text[i] for i in ids])))
    for r in got:
        if r.doc_id in text:
            assert r.n_chars == len(text[r.doc_id]) and r.fingerprint == fp[r.doc_id]
            at = ids.index(r.doc_id) + 1
            if at < len(ids) and not {7, None} & {ids[at]} and not (ids[at] < 7 < r.doc_id):
                nxt = text[ids[at]]
                edited = P._edited(text[r.doc_id], nxt)
                assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
                assert r.near_next == P.likeness(fp[r.doc_id], fp[ids[at]]) and r.near_edited == P.likeness(r.fingerprint, r.edited_fingerprint)
    long_ = [r for r in got if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long_]) > 0.4 and np.mean([r.near_next for r in long_]) < 0.25
    assert fp[503] == fp[504]


def test_last_meets_first_and_few_rows(spark):
    got = {r.doc_id: r for r in P.edit_test(spark.createDataFrame([(1, "abcd"), (2, "efgh"), (3, "ijkl")], "doc_id long, text string")).collect()}
    for d, want in ((1, "abij"), (2, "efab"), (3, "ijef")):
        assert got[d].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
    one = P.edit_test(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert P.edit_test(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_pairs(spark):
    rng = random.Random(6)
    base = [words(rng, 200) for _ in range(10)]
    rows = list(enumerate(base + [t + " end" for t in base[:5]] + [base[7], None, ""]))
    got = {(r.a, r.b) for r in P.near_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, 10 + i) for i in range(5)}


def united(pairs, n):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("tile", [4096, 7])
def test_links_inside_bands_equal_all_pairs(spark, monkeypatch, tile):
    """Members of a band that are not like its smallest id but like each other."""
    monkeypatch.setattr(P, "TILE", tile)
    rng = random.Random(1)
    base, texts = words(rng, 120), []
    for _ in range(60):
        t = base
        for _ in range(2):
            w = int(len(base) * rng.uniform(.03, .12))
            at = rng.randrange(len(base) - w)
            t = t[:at] + words(rng, w)[:w] + t[at + w:]
        texts.append(t)
    fp = P.fingerprints(texts)
    keys = [set(P.band_keys(f)) for f in fp]
    alike = {(a, b): P.likeness(fp[a], fp[b]) for b in range(60) for a in range(b) if keys[a] & keys[b] and P.likeness(fp[a], fp[b]) >= 0.75}
    got = {(r.a, r.b): r.likeness for r in P.near_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got.items() <= alike.items() and united(got, 60) == united(alike, 60)
    smallest = {(min(i for i in range(60) if x in keys[i]), j) for j in range(60) for x in keys[j]} & alike.keys()
    assert united(smallest, 60) != united(alike, 60)
