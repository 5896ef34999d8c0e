"""Quality rules with an n-gram language model: modified Kneser-Ney over bytes, counted by Spark.

Units are the bytes of a text's words, each word after one space; an n-gram is `ORDER` of them and fits a 64-bit integer,
so counts are exact. Steps:

1. every task counts the n-grams of all its texts and sends one row per distinct n-gram (a task that holds many sends
   what it has and goes on), Spark adds them up;
2. lower orders are continuation counts (how many different bytes stand before them); discounts of every order come from
   the numbers of n-grams that occur once to four times; probabilities are interpolated from the lowest order up, each
   order one aggregation and two joins of the count tables;
3. the model is stored as arrays sorted by a one-to-one hash of the n-gram, in ranges of the hash. A lookup jumps to the
   place that the leading bits of the hash give and steps on from there;
4. documents are read again and get their negative log-probability per letter or digit: marks cost what they cost but do
   not add to the length, so marks between or behind words raise the value. A model up to `BROADCAST_BYTES` is broadcast;
   with a larger one tasks read its ranges from the shared folder, one at a time, for many texts at once;
5. every language has a band of log-perplexity around its median; documents above or below it are rejected.

Every n-gram that is looked up has been counted, in the same texts, so no n-gram is missing from the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as T
from .common import written

ORDER = 5
#: distinct n-grams that a task holds before it sends them
HOLD = 2_000_000
#: bytes of a model that is broadcast, 12 bytes an n-gram; entries of a range of the stored arrays
BROADCAST_BYTES = 64 << 20
RANGE = 1 << 20
#: bytes of text that are looked up together where the model is read range by range
TOGETHER = 16 << 20
#: fixed bounds of the base rules
LEAST_WORDS, REPEAT_PERCENT = 50, 50
#: reach of a language's band below and above the median, in median absolute deviations and at least in nats a letter
BELOW, ABOVE = (14.0, 0.3), (7.0, 0.15)

_U = np.uint64
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NO_NEWLINE = np.ones(256, bool)
_NO_NEWLINE[10] = False

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


# ---------------------------------------------------------------- base measures

def _in_doc(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that are equal only for equal hashes of one document."""
    return T.mix(h ^ T.mix(doc.astype(np.uint64) + _U(1)))


def measures(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of `MEASURES` per text, from UTF-8 bytes and offsets."""
    docs = len(offs) - 1
    per = lambda own, weights=None: np.bincount(own, weights, docs).astype(np.int64) if len(own) else np.zeros(docs, np.int64)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offs])
    s, e, doc = T.word_spans(data, offs, T.NOT_SPACE)
    in_words = T.NOT_SPACE[data]
    chars = total(in_words & ((data & 0xC0) != 0x80))
    # lines with a word: those equal to an earlier one
    ls, le, ldoc = T.word_spans(data, offs, _NO_NEWLINE)
    before = np.concatenate(([0], np.cumsum(in_words)))
    some = before[le] > before[ls]
    ls, le, ldoc = ls[some], le[some], ldoc[some]
    _, first = np.unique(_in_doc(ldoc, T.word_hashes(data, ls, le)), return_index=True)
    lines = per(ldoc) - per(ldoc[first])
    # words inside three-word windows that the text has twice or more
    h = T.word_hashes(data, s, e)
    tri = T.rolling(h, 3)
    place = np.flatnonzero(doc[:len(tri)] == doc[2:]) if len(tri) else np.zeros(0, np.int64)
    _, back, count = np.unique(_in_doc(doc[place], tri[place]), return_inverse=True, return_counts=True)
    place = place[count[back.ravel()] > 1] if len(place) else place
    repeated = np.zeros(len(h), bool)
    for j in range(3):
        repeated[place + j] = True
    return np.stack([per(doc), chars, total(_SYMBOL[data]), lines, per(doc[repeated])], axis=1)


# ---------------------------------------------------------------- n-grams

def grams(data: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of every text as integers, the first byte highest, and their documents. The first order - 1 bytes of a
    text are context only."""
    s, e, doc = T.word_spans(data, offs, T.NOT_SPACE)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = e - s + 1
    at = np.arange(int(size.sum())) + np.repeat(s - 1 - (np.cumsum(size) - size), size)
    head = np.cumsum(size) - size
    at[0] = 0
    b = data[at].astype(np.int64)
    b[head] = 32
    own = np.repeat(doc, size)
    n = len(b) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = np.zeros(n, np.int64)
    for j in range(order):
        v = v << 8 | b[j:j + n]
    ok = own[:n] == own[order - 1:]
    return v[ok], own[:n][ok]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    k, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def counts(docs: DataFrame, order: int = ORDER, hold: int = HOLD) -> DataFrame:
    """gram, c over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in T.slices(batch):
                parts.append(np.unique(grams(*T.flat(part.column("text")), order)[0], return_counts=True))
                held += len(parts[-1][0])
                if held > hold:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held > hold // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], ["gram", "c"])
                        parts, held = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(parts)], ["gram", "c"])

    x = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, c long")
    return x.groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more from the numbers of n-grams with counts 1 to 4; where a table is too small to
    say, the usual 1/2, 1 and 3/2."""
    if min(n) == 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    d = [i - (i + 1) * y * n[i] / n[i - 1] for i in (1, 2, 3)]
    return d if all(0 <= x <= i + 1 for i, x in enumerate(d)) else [0.5, 1.0, 1.5]


def model(full: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, p: interpolated modified Kneser-Ney probability of the last byte of every n-gram after the others."""
    tables = {order: full}
    for k in range(order - 1, 0, -1):
        longer = tables[k + 1]
        tables[k] = written(longer.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("c")), f"order{k}")
    p = None
    for k in range(1, order + 1):
        t = tables[k]
        n = t.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        d = discounts([int(n[f"n{i}"]) for i in (1, 2, 3, 4)])
        less = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        x = t.withColumns({"before": F.shiftright("gram", 8), "gone": less})
        context = x.groupBy("before").agg(F.sum("c").alias("total"), F.sum("gone").alias("free"))
        x = x.join(context, "before")
        own, free = (F.col("c") - F.col("gone")) / F.col("total"), F.col("free") / F.col("total")
        if p is None:
            p = x.select("gram", (own + free / 256.0).alias("p"))
        else:
            x = x.withColumn("rest", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            p = x.join(p.select(F.col("gram").alias("rest"), F.col("p").alias("lower")), "rest").select("gram", (own + free * F.col("lower")).alias("p"))
    return p


# ---------------------------------------------------------------- sorted hash arrays

class Sorted:
    """Values by hash, looked up from the place that the leading bits give."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        bits = max(1, int(len(keys)).bit_length())
        self.shift = _U(64 - bits)
        self.at = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Values of hashes that are all among the keys."""
        at = self.at[(h >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.keys[at] < h)
        while len(todo):
            at[todo] += 1
            todo = todo[self.keys[at[todo]] < h[todo]]
        return self.values[at]


def hashed(gram: np.ndarray) -> np.ndarray:
    return T.mix(gram.astype(np.uint64))


def stored(p: DataFrame, entries: int) -> DataFrame:
    """range, keys, values: the model as sorted arrays, a range holds the hashes of equal leading bits."""
    bits = max(0, (max(1, entries) - 1) // RANGE).bit_length()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashed(batch.column("gram").to_numpy())
            part = (h >> _U(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(h.view(np.int64)), batch.column("lp")], ["range", "h", "lp"])

    def pack(key, t):
        h, lp = t.column("h").to_numpy().view(np.uint64), t.column("lp").to_numpy()
        order = np.argsort(h)
        return pa.table({"range": [key[0].as_py()], "keys": [h[order].astype("<u8").tobytes()], "values": [lp[order].astype("<f4").tobytes()]},
                        pa.schema([("range", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())]))

    x = p.select("gram", F.log("p").alias("lp")).mapInArrow(place, "range int, h long, lp double")
    return written(x.groupBy("range").applyInArrow(pack, "range int, keys binary, values binary"), "model")


def _arrays(rows) -> Sorted:
    rows = sorted(rows, key=lambda r: r[0])
    return Sorted(np.frombuffer(b"".join(r[1] for r in rows), "<u8"), np.frombuffer(b"".join(r[2] for r in rows), "<f4"))


def _ranges(files: list[str], columns: list[str]):
    """Rows of the stored arrays, one file after the other, from the shared folder."""
    import pyarrow.parquet as pq
    from .tokens import _filesystem
    for file in files:
        fs, path = _filesystem(file)
        f = pq.ParquetFile(path, filesystem=fs)
        for batch in f.iter_batches(batch_size=1, columns=columns):
            yield from zip(*[batch.column(c).to_pylist() for c in columns])


def scored(docs: DataFrame, arrays: DataFrame, entries: int, carry: list[str], broadcast_bytes: int = BROADCAST_BYTES, order: int = ORDER) -> DataFrame:
    """`carry` columns, `MEASURES` and log_perplexity (null without an n-gram) of every text."""
    spark = docs.sparkSession
    small = 12 * entries <= broadcast_bytes
    # at most broadcast_bytes
    shared = spark.sparkContext.broadcast([tuple(r) for r in arrays.select("range", "keys", "values").collect()]) if small else None
    files = [] if small else arrays.inputFiles()
    bits = max(0, (max(1, entries) - 1) // RANGE).bit_length()
    whole: list[Sorted] = []

    def values(v: np.ndarray) -> np.ndarray:
        h = hashed(v)
        if not len(h):
            return np.zeros(0)
        if small:
            if not whole:
                whole.append(_arrays(shared.value))
            return whole[0].find(h).astype(np.float64)
        part = (h >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        by = np.argsort(part, kind="stable")
        out, part = np.zeros(len(h)), part[by]
        for row in _ranges(files, ["range", "keys", "values"]):
            a, b = np.searchsorted(part, [row[0], row[0] + 1])
            if b > a:
                out[by[a:b]] = _arrays([row]).find(h[by[a:b]])
        return out

    def result(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [grams(*T.flat(p.column("text")), order) for p in parts]
        lp = values(np.concatenate([f[0] for f in found]))
        at = 0
        for p, (v, own) in zip(parts, found):
            n, letters = np.bincount(own, minlength=p.num_rows), np.bincount(own, T.ALNUM[v & 255], p.num_rows)
            total = np.bincount(own, lp[at:at + len(v)], p.num_rows)
            at += len(v)
            m = measures(*T.flat(p.column("text")))
            mean = pa.array(-total / np.maximum(letters, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([*[p.column(c) for c in carry], *[pa.array(m[:, i]) for i in range(len(MEASURES))], mean],
                                             [*carry, *MEASURES, "log_perplexity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for p in T.slices(batch):
                parts.append(p)
                held += p.nbytes
                if small or held > TOGETHER:
                    yield from result(parts)
                    parts, held = [], 0
        if parts:
            yield from result(parts)

    kinds = ", ".join([*[f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry], *[f"{m} long" for m in MEASURES], "log_perplexity double"])
    return docs.select(*carry, "text").mapInArrow(run, kinds)


# ---------------------------------------------------------------- rules

def base_failed(words: Column, repeated: Column) -> Column:
    return (words < LEAST_WORDS) | (100 * repeated > REPEAT_PERCENT * words)


def bands(x: DataFrame, below: tuple[float, float] = BELOW, above: tuple[float, float] = ABOVE) -> DataFrame:
    """lang, lower, upper: median log-perplexity of a language and how far its band reaches from there. Texts that fail the
    base rules do not count; equal values of texts of equal length (copies) count once; values are rounded to 1/1000."""
    v = x.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
    v = v.select("lang", "n_words", F.round("log_perplexity", 6).alias("lp")).distinct()
    v = written(v.groupBy("lang", F.round("lp", 3).alias("lp")).agg(F.count(F.lit(1)).alias("n")), "histogram")
    mid = v.groupBy("lang").agg(F.percentile("lp", 0.5, F.col("n")).alias("mid"))
    y = v.join(mid, v["lang"].eqNullSafe(mid["lang"])).drop(mid["lang"])
    y = y.groupBy("lang", "mid").agg(F.percentile(F.abs(F.col("lp") - F.col("mid")), 0.5, F.col("n")).alias("mad"))
    reach = lambda r: F.greatest(F.lit(r[1]), r[0] * F.col("mad"))
    return y.select("lang", (F.col("mid") - reach(below)).alias("lower"), (F.col("mid") + reach(above)).alias("upper"))


def judge(docs: DataFrame, order: int = ORDER, below: tuple[float, float] = BELOW, above: tuple[float, float] = ABOVE,
          broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Base rules and perplexity bands for every whole text.

    Input: doc_id, text, lang; other columns are ignored. Output per input row: doc_id, lang, n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, log_perplexity (nats a letter; null for texts of fewer than `order` units),
    base_failed, lower, upper (the language's band; null where no text of it passes the base rules), kept. The model is
    counted over all rows, repeated ones as often as they come. Null text is empty and fails the base rules; a null
    language is one of its own; a null doc_id stays null; an empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    full = written(counts(d, order), "counts")
    entries = full.count()
    arrays = stored(model(full, order), entries)
    x = scored(d, arrays, entries, ["doc_id", "lang"], broadcast_bytes, order)
    x = written(x.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))), "scored")
    b = bands(x, below, above)
    y = x.join(b, x["lang"].eqNullSafe(b["lang"]), "left").drop(b["lang"])
    inside = F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(True))
    return y.withColumn("kept", ~F.col("base_failed") & inside)
