import zlib
from collections import Counter

from sigspark.llm import sharding as S


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", None) for i, t in rows], "doc_id long, text string, shard string, slot string")


def test_whole_contract(spark):
    rows = [(i, f"text {i % 700}") for i in range(1000)] + [(5000 + i, "one group of copies") for i in range(600)] + [(7000, None), (7001, ""), (7002, "é" * 9)]
    got = S.shard(docs(spark, rows), 16).collect()
    text = dict(rows)
    assert len(got) == len(rows) and {r.doc_id for r in got} == set(text)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)
    n = Counter(r.shard for r in got)
    assert set(n) <= set(range(16)) and max(n.values()) - min(n[s] for s in range(16)) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    # the group of copies overflows, other rows stay at home unless their shard is full
    assert sum(r.home == r.shard for r in got if r.doc_id < 5000) >= 800


def test_place_is_the_walk_of_single_rows():
    arcs = S.ring(5, 8)
    counts = {a: (a * 7) % 11 for a in range(len(arcs))}
    got = S.place(counts, arcs, 5)
    total = sum(counts.values())
    room = [total // 5 + (s < total % 5) for s in range(5)]
    left, where = dict(counts), {}
    ways = S._clockwise(arcs)
    for r in range(5):
        for a in range(len(arcs)):
            for _ in range(left[a]):
                s = ways[a][r]
                if room[s]:
                    room[s] -= 1
                    left[a] -= 1
                    where[a, counts[a] - left[a] - 1] = s
    assert {(a, k): s for a, lo, hi, s, _ in got for k in range(lo, hi)} == where
    assert not any(room) and not any(left.values())


def test_few_rows_repeated_rows_and_none(spark):
    got = S.shard(docs(spark, [(1, "a"), (1, "a"), (None, None)]), 16).collect()
    assert len(got) == 3 and max(Counter(r.shard for r in got).values()) == 1 and all(r.slot == 0 for r in got)
    assert S.shard(docs(spark, []), 16).count() == 0


def test_ring_covers_every_cell_once():
    cells = sorted(c for a, b, _ in S.ring(16) for c in range(a, b + 1))
    assert cells == list(range(S.CELLS))
