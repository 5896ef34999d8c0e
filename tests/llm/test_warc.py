import base64
import gzip
import hashlib
import random
from glob import glob

import pytest
from pyspark.sql import functions as F

from sigspark.llm import warc as W


def test_loser_tree():
    rng = random.Random(2)
    for k in range(0, 9):
        runs = [sorted(((f"k{rng.randrange(9)}", f"t{rng.randrange(3)}", rng.choice([None, 1, 2, 3]), *[None] * 5, f"f{i}", j) for j in range(rng.randrange(12))), key=W.order_key) for i in range(k)]
        got = list(W.LoserTree([iter(r) for r in runs]))
        assert got == sorted((c for r in runs for c in r), key=W.order_key)


def pages():
    rng = random.Random(3)
    html = [f"<p>{i}\r\n\r\nWARC/1.1 é</p>" for i in range(30)] + ["", "same", "x" * 300_000]
    rows = [(i, f"http://www.h{rng.randrange(4)}.example.com:80/P{rng.randrange(9)}#f", rng.choice(html)) for i in range(200)]
    rows += [(900, None, None), (901, "http://a.b/\n%0A", "same"), (None, "http://n.o/", "same"), (901, "http://a.b/", "same"), (902, "", "only me"), (None, None, "alone")]
    return rows


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record_type": F.lit("k"), "value": F.lit(1)}).repartition(4)
    folder = W.write(df, str(tmp_path / "w"), least)
    got = W.merged_index(spark, folder, 40).collect()
    assert len(got) == len(rows)
    raw = {i: (t or "").encode() for i, _, t in rows if i is not None}
    last = {}
    for i, t in raw.items():
        last[t] = max(i, last.get(t, -1))
    many = {t: sum((x[2] or "").encode() == t for x in rows) for t in raw.values()}
    for r in got:
        t = raw[r.page_id] if r.page_id is not None else {"http://n.o/": b"same", None: b"alone"}[r.url]
        assert r.payload_bytes == len(t) and r.payload_digest == base64.b32encode(hashlib.sha1(t).digest()).decode()
        again = len(t) >= least and many.get(t, 1) > 1 and last[t] != r.page_id
        assert (r.record_type, r.refers_to) == (("revisit", last[t]) if again else ("response", None))
    # captures of a range come in order, and ranges follow each other
    order = [W.order_key((r.url_key, r.timestamp, r.page_id, *[None] * 5, r.archive, r.offset)) for r in got]
    for k in {r.key_range for r in got}:
        part = [o for o, r in zip(order, got) if r.key_range == k]
        assert part == sorted(part)
    cut = [(min(o[:2] for o, r in zip(order, got) if r.key_range == k), max(o[:2] for o, r in zip(order, got) if r.key_range == k)) for k in sorted({r.key_range for r in got})]
    assert len(cut) > 3 and all(a[1] <= b[0] for a, b in zip(cut, cut[1:]))
    # offsets find the records in the files
    files = {f.rsplit("/", 1)[-1]: gzip.decompress(open(f, "rb").read()) for f in glob(f"{folder}/*.gz")}
    for r in got:
        assert files[r.archive][r.offset:r.offset + r.length].startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())


def test_damage_is_seen():
    good = W._record(1, "http://a.b/", "text", 4, W.base32_sha1(b"text"), None, False).encode() + b"\r\n\r\n"
    assert [W._capture(*x, "f")[4] for x in W.parse(good)] == ["response"]
    with pytest.raises(ValueError):
        [W._capture(*x, "f") for x in W.parse(good.replace(b"text\r", b"tex!\r"))]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.archive(df, str(tmp_path / "e")).count() == 0


def test_url_key():
    assert W.url_key("http://www.Example.com:8080/A?b#c") == "com,example)/a?b" and W.url_key(None) == "" and W.url_key("HTTPS://u@x.y") == "y,x)"
