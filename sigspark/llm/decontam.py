"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

A window is 13 successive words of a benchmark item (a shorter item is one window). A window occurs in a document only if
all its 5-word shingles do, so one of them, its prefix token, is enough to find it: the one that the fewest documents
contain. Steps:

1. document frequency of every item shingle over all documents (one pass, one row per shingle and partition shuffled);
2. the rarest shingle of each window becomes its prefix token; the index of prefix tokens is broadcast. The benchmark is
   taken in blocks of at most about `BLOCK_BYTES` of text, so the broadcast has a fixed bound and any size is covered;
3. one pass over the documents probes the index, applies the bounds (the window must lie inside the document at the
   position that the token's offset gives) and verifies the candidates word by word over the whole window.

No text is shuffled; a result row holds merged word spans and item ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as T

WINDOW = 13
SHINGLE = 5
BLOCK_BYTES = 8 << 20

_U = np.uint64


class Index:
    """Windows of one block of items and, once frequencies are known, their prefix tokens."""

    def __init__(self, ids: list, texts: list, window: int, k: int):
        data, offs = T.flat(pa.array(texts, pa.string()))
        data = T.LOWER[data]
        s, e, doc = T.word_spans(data, offs, T.ALNUM)
        h = T.word_hashes(data, s, e)
        count = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
        first = np.cumsum(count) - count
        length = np.minimum(count, window)
        n = np.where(count > 0, count - length + 1, 0)
        item = np.repeat(np.arange(len(texts)), n)
        start = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        length = length[item]
        words = np.zeros((len(item), window), np.uint64)
        for j in range(window):
            on = length > j
            words[on, j] = h[start[on] + j]
        # equal windows are one, with all their items
        full = np.concatenate((words, length[:, None].astype(np.uint64)), axis=1)
        full, which = np.unique(full, axis=0, return_inverse=True) if len(full) else (full, np.zeros(0, np.int64))
        self.words, self.length = np.ascontiguousarray(full[:, :window]), full[:, window].astype(np.int64)
        pair = np.unique(which.ravel() * max(1, len(texts)) + item)
        self.items = pair % max(1, len(texts))
        self.item_at = np.searchsorted(pair // max(1, len(texts)), np.arange(len(full) + 1))
        self.ids = np.array([x if x is not None else -1 for x in ids], np.int64)
        self.has_id = np.array([x is not None for x in ids], bool)
        # shingles of every window: k words, or all of a shorter one
        self.sizes = sorted(set(np.minimum(self.length, k).tolist()))
        gram, own, off, size = [], [], [], []
        for w in self.sizes:
            rows = np.flatnonzero(np.minimum(self.length, k) == w)
            for o in range(int(self.length[rows].max()) - w + 1):
                r = rows[self.length[rows] >= o + w]
                v = np.zeros(len(r), np.uint64)
                for j in range(w):
                    v += self.words[r, o + j] * T.PLACE[j]
                gram.append(T.mix(v + _U(w)))
                own.append(r)
                off.append(np.full(len(r), o))
                size.append(np.full(len(r), w))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        gram, self.own, self.off, size = cat(gram, np.uint64), cat(own, np.int64), cat(off, np.int64), cat(size, np.int64)
        self.grams, first, self.gram = np.unique(gram, return_index=True, return_inverse=True)
        self.gram_size = size[first] if len(size) else size

    def choose(self, frequency: np.ndarray) -> None:
        """Keep the rarest shingle of each window; ties go to the smaller hash, then to the earlier place."""
        order = np.lexsort((self.off, self.gram, frequency[self.gram], self.own))
        one = order[np.concatenate(([True], self.own[order][1:] != self.own[order][:-1]))] if len(order) else order
        one = one[np.argsort(self.gram[one], kind="stable")]
        used, at = np.unique(self.gram[one], return_index=True)
        self.prefix, self.prefix_size = self.grams[used], self.gram_size[used]
        self.prefix_at = np.append(at, len(one))
        self.window, self.offset = self.own[one], self.off[one]
        self.own = self.off = self.gram = self.grams = self.gram_size = None


def _doc_words(column):
    data, offs = T.flat(column)
    data = T.LOWER[data]
    s, e, doc = T.word_spans(data, offs, T.ALNUM)
    docs = len(offs) - 1
    count = np.bincount(doc, minlength=docs) if len(doc) else np.zeros(docs, np.int64)
    return T.word_hashes(data, s, e), doc, count


def _found(h: np.ndarray, doc: np.ndarray, w: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of w-word shingles that are in the sorted array `known`, with their index there."""
    r = T.rolling(h, w)
    if not len(r) or not len(known):
        z = np.zeros(0, np.int64)
        return z, z
    at = np.minimum(np.searchsorted(known, r), len(known) - 1)
    pos = np.flatnonzero((known[at] == r) & (doc[:len(r)] == doc[w - 1:]))
    return pos, at[pos]


def _frequency(docs: DataFrame, index: Index) -> np.ndarray:
    shared = docs.sparkSession.sparkContext.broadcast((index.grams, index.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sizes = shared.value
        n = np.zeros(len(grams), np.int64)
        for batch in batches:
            for part in T.slices(batch):
                h, doc, _ = _doc_words(part.column("text"))
                for w in sizes:
                    pos, g = _found(h, doc, w, grams)
                    pair = np.unique(doc[pos] * len(grams) + g)
                    n += np.bincount(pair % max(1, len(grams)), minlength=len(grams))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["gram", "n"])

    t = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(index.grams), np.int64)
    out[t.column("gram").to_numpy()] = t.column("n").to_numpy()
    return out


def _occurrences(column, index: Index):
    """Per document of a slice: words, covered words, covered runs (doc, from, to) and (doc, item) pairs."""
    h, doc, count = _doc_words(column)
    first = np.cumsum(count) - count
    starts, wins = [], []
    for w in sorted(set(index.prefix_size.tolist())):
        sel = np.flatnonzero(index.prefix_size == w)
        pos, g = _found(h, doc, w, index.prefix[sel])
        g = sel[g]
        n = index.prefix_at[g + 1] - index.prefix_at[g]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.prefix_at[g], n)
        p, win = np.repeat(pos, n), index.window[at]
        s, length = p - index.offset[at], index.length[win]
        d = doc[p]
        ok = (s >= first[d]) & (s + length <= first[d] + count[d])
        s, win, length = s[ok], win[ok], length[ok]
        for j in range(index.words.shape[1]):
            ok = (length <= j) | (h[np.minimum(s + j, max(0, len(h) - 1))] == index.words[win, j])
            s, win, length = s[ok], win[ok], length[ok]
        starts.append(s)
        wins.append(win)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    win = np.concatenate(wins) if wins else np.zeros(0, np.int64)
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, s, 1)
    np.add.at(cover, s + index.length[win], -1)
    hit = np.cumsum(cover)[:-1] > 0
    n_hit = np.bincount(doc[hit], minlength=len(count)) if len(h) else np.zeros(len(count), np.int64)
    edge = hit.copy()
    if len(h):
        edge[1:] = hit[1:] & ~(hit[:-1] & (doc[1:] == doc[:-1]))
    run_s = np.flatnonzero(edge)
    last = hit.copy()
    if len(h):
        last[:-1] = hit[:-1] & ~(hit[1:] & (doc[1:] == doc[:-1]))
    run_e = np.flatnonzero(last) + 1
    own = doc[s]
    n = index.item_at[win + 1] - index.item_at[win]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(index.item_at[win], n)
    size = max(1, len(index.ids))
    pair = np.unique(np.repeat(own, n) * size + index.items[at])
    pair = pair[index.has_id[pair % size]]
    return count, n_hit, (doc[run_s], run_s - first[doc[run_s]], run_e - first[doc[run_s]]), (pair // size, index.ids[pair % size])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        t = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toArrow()
        yield t.column("item_id").to_pylist(), t.column("text").to_pylist()


def _indexes(docs: DataFrame, benchmark: DataFrame, window: int, k: int, block_bytes: int) -> Iterator[Index]:
    for ids, texts in _blocks(benchmark, block_bytes):
        x = Index(ids, texts, window, k)
        x.choose(_frequency(docs, x))
        yield x


_SPANS = "array<struct<start:bigint,end:bigint>>"
_ROW = f"doc_id long, _key binary, n_words long, n_hit long, spans {_SPANS}, items array<long>"


def _pass(docs: DataFrame, index: Index, all_rows: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for batch in batches:
            for part in T.slices(batch):
                count, n_hit, (d, a, b), (di, ids) = _occurrences(part.column("text"), x)
                o = np.searchsorted(d, np.arange(len(count) + 1)).astype(np.int32)
                p = np.searchsorted(di, np.arange(len(count) + 1)).astype(np.int32)
                spans = pa.ListArray.from_arrays(pa.array(o), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["start", "end"]))
                out = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_key"), pa.array(count.astype(np.int64)), pa.array(n_hit.astype(np.int64)), spans,
                     pa.ListArray.from_arrays(pa.array(p), pa.array(ids))], ["doc_id", "_key", "n_words", "n_hit", "spans", "items"])
                yield out if all_rows else out.filter(pa.array(n_hit > 0))

    t = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.alias("text"), F.unhex(F.sha1(t)).alias("_key")).mapInArrow(run, _ROW)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where item windows occur in documents.

    Words are runs of digits, ASCII letters (in lower case) and characters beyond ASCII. Output per input row: doc_id,
    n_words, n_hit (words inside any occurrence), spans (merged runs of hit words, end exclusive), items (sorted ids of
    the items with an occurring window). Null text has no words; an item without words has no window. Repeated rows give
    repeated results; repeated item ids are one item; an item without id marks words but is not listed. Other columns
    are ignored, an empty benchmark hits nothing, empty documents give an empty result.
    """
    base, more = None, None
    for x in _indexes(docs, benchmark, window, k, block_bytes):
        if base is None:
            base = _pass(docs, x, True)
        else:
            part = _pass(docs, x, False).groupBy("_key").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
            more = part if more is None else more.union(part)
    if more is not None:
        more = more.groupBy("_key").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
        base = base.join(more, "_key", "left")
        both = F.array_sort(F.concat("spans", F.coalesce("_spans", F.array().cast(_SPANS))))
        base = base.withColumn("spans", _merged(both)).withColumn("items", F.concat("items", F.coalesce("_items", F.array().cast("array<long>"))))
        base = base.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    return base.select("doc_id", "n_words", "n_hit", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def _merged(spans):
    """Union of sorted spans."""
    empty = F.array().cast(_SPANS)

    def add(acc, s):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["end"], grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, empty, add)


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of which less than a twentieth of the words is inside benchmark windows; columns and rows as given."""
    indexes = list(_indexes(docs, benchmark, window, k, block_bytes)) if _one_block(benchmark, block_bytes) else None
    if indexes is None:
        t = F.col("text").cast("string")
        found = docs.select(F.unhex(F.sha1(t)).alias("_k"), t.alias("text"), F.lit(0).alias("doc_id"))
        bad = None
        for x in _indexes(docs, benchmark, window, k, block_bytes):
            p = _pass(found, x, False).select("_key", "n_words", "spans")
            bad = p if bad is None else bad.union(p)
        bad = bad.groupBy("_key", "n_words").agg(F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"))
        n_hit = F.aggregate(_merged(F.col("spans")), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
        bad = bad.where(is_contaminated(n_hit, F.col("n_words"))).select(F.col("_key").alias("_decontam_key"))
        key = F.coalesce(F.unhex(F.sha1(t)), F.lit(b""))
        return docs.withColumn("_decontam_key", key).join(bad, "_decontam_key", "left_anti").select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(indexes[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for batch in batches:
            for part in T.slices(batch):
                count, n_hit, _, _ = _occurrences(part.column("text"), x)
                yield part.filter(pa.array(~((n_hit > 0) & (20 * n_hit >= count))))

    return docs.mapInArrow(run, docs.schema)


def _one_block(benchmark: DataFrame, block_bytes: int) -> bool:
    return (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= block_bytes
