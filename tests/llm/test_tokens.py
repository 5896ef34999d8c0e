import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.llm import tokens as K
from sigspark.llm.queries import tokenizer_path


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def direct(texts, name="word_bpe_49k.json"):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path(name))
    return [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts():
    rng = random.Random(8)
    parts = ["The", "it's", "IT'S,", "don't.", "ÉTÉ", "é", " ́x", "a\x1cb", "a\x85b", "a b", " ", "x1y22", "...", "!?", "<|endoftext|>", "<|startoftext|>a",
             "Σ", "ΣΑΣ", "İ", "😀", "###", "they're", "'s", "'S", "'", "s's.", "A.B.C.", "\t", "\r\n", "\n", "  ", "word", "Longerwordhere,", "42%", "$5", "ﬁ", "ẞ", "\0"]
    return ["", " ", "\n\n"] + [rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_word_by_word_is_the_whole_text(name, monkeypatch):
    monkeypatch.setattr(K, "REMEMBER", 60)
    e = K.Encoder(tokenizer_path(name))
    assert e.by_word == name.startswith("word")
    texts = odd_texts()
    want = direct(texts, name)
    for i in range(0, len(texts), 50):
        assert e.encode(texts[i:i + 50]) == want[i:i + 50]


def test_frames_and_damage():
    out = io.BytesIO()
    w = K.Writer(out)
    docs = [(3, b"\1\0\0\0" * 9), (None, b"\1\0\0\0"), (7, np.arange(50_000, dtype="<u4").tobytes())]
    for d in docs:
        w.add(*d)
    w.close()
    data = out.getvalue()
    r = K.Reader(Source(data))
    assert r.index == [3, None, 7] and [r.ids(i) for i in (2, 0, 1)] == [docs[2][1], docs[0][1], docs[1][1]]
    import zstandard
    d = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert d == b"".join(x for _, x in docs)  # any zstandard reader sees the ids
    bad = bytearray(data)
    bad[int(r.at[2]) + 20] ^= 1
    with pytest.raises(Exception):
        K.Reader(Source(bytes(bad))).ids(2)


def test_round_trip(spark, tmp_path):
    rows = list(enumerate(odd_texts())) + [(1000, None), (None, "none"), (5, "again"), (5, "again"), (2000, "word " * 30_000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("k"), "ids": F.lit(1)}).repartition(3)
    m = K.write(df, str(tmp_path / "t"), tokenizer_path())
    got = sorted(K.read(m).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(-1 if i is None else i for i, _ in rows)
    want = {}
    for (i, _), ids in zip(rows, direct([t or "" for _, t in rows])):
        want.setdefault(i, []).append(ids + b"\1\0\0\0")
    at = 0
    for r in got:
        assert r.ids in want[r.doc_id] and r.start == at and r.n_tokens == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    assert {r.doc_id: bytes(r.ids) for r in K.read(m, [7, 2000]).collect()} == {7: want[7][0], 2000: want[2000][0]}


def test_empty_table(spark, tmp_path):
    assert K.round_trip(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(), str(tmp_path / "e")).count() == 0
