"""Periodic runs of words: an online dynamic program over sparse diagonals.

A run of period p is a diagonal of the word-by-word match matrix: every word from some place on equals the word p before
it. Reading a text from left to right, each word looks up its earlier occurrences; the lag to each of them names a
diagonal, whose match length grows by one if it was active at the word before. A diagonal that ends with as many matches
as its lag (and matches + lag of at least 12 words) emits its run at once.

An occurrence is looked up with its left context, which makes the diagonals sparse and loses none that is emitted: a run
of period p has at least max(p, 12 - p) successive matches, so a lag below 48 needs six equal words in a row, a lag from
48 on needs 48, one from 384 on 384, and so on. Each of these levels reads the places of its own lags only.

Inside a run of period q that is already established, occurrences at lags of 2q and more within the same run are skipped
in one step: a run of period p >= 2q that lies in them would have period gcd(p, q), and any other one has a match with at
least one end outside, from where its diagonal is extended word by word to both sides. So a text of one repeated word costs
a constant number of steps per word. Only long stretches of small periods that themselves recur with breaks cost up to the
length of a stretch per word.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import text as T

LEAST = 12
#: successive matches that a lag of the first level needs; a level ends at STEP times its words
SEED = 6
STEP = 8


def words(text: str | None) -> list[bytes]:
    """Runs of other characters than space and 09-0D."""
    return (text or "").encode().split()


def _levels(codes: np.ndarray):
    """(words of a seed, first lag, lag after the last, hash of the seed that ends at each word from the first one on)."""
    n, w = len(codes), SEED
    h, low = T.rolling(T.mix(codes.astype(np.uint64)), SEED), 1
    while len(h) > 1 and low <= n // 2:
        yield w, low, w * STEP, h
        low, k = w * STEP, len(h) - (STEP - 1) * w
        if k <= 1:
            return
        longer = np.zeros(k, np.uint64)
        for j in range(STEP):
            longer += h[j * w:j * w + k] * T.PLACE[j]
        h, w = T.mix(longer), w * STEP


def runs(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run with its smallest period, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    w = None
    for seed, low, high, h in _levels(codes):
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(h), bool)
        same[1:] = h[order][1:] == h[order][:-1]
        gap = np.diff(order, prepend=order[:1])
        if not (same & (gap < high)).any():
            continue
        if w is None:
            w = codes.tolist()
        # rank of every place among the sorted ones, first rank of its group, places whose last occurrence is near enough
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        near = np.zeros(len(h), bool)
        near[order] = same & (gap < high)
        at = np.flatnonzero(near)
        _walk(w, at.tolist(), rank[at].tolist(), head[rank[at]].tolist(), order.tolist(), seed, low, high, least, found)
    return sorted((s, e - s + 1, p) for (s, e), p in found.items())


def _walk(w: list[int], places: list[int], ranks: list[int], heads: list[int], order: list[int], seed: int, low: int, high: int, least: int,
          found: dict[tuple[int, int], int]) -> None:
    """The dynamic program for the lags from `low` to `high`; a place is the start of a seed, its last word is seed - 1 on."""
    n, tail = len(w), seed - 1
    known = sorted((s, e, p) for (s, e), p in found.items())
    next_known, inside = 0, []
    active: dict[int, int] = {}  # lag: first word that matches
    done: dict[int, int] = {}  # lag: last word of its last diagonal
    last = -2

    def end(lag: int, first: int, i: int) -> None:
        while i + 1 < n and w[i + 1] == w[i + 1 - lag]:  # only a diagonal whose later matches were skipped
            i += 1
        done[lag] = i
        if i - first + 1 >= lag and i - first + 1 + lag >= least:
            key = (first - lag, i)
            if found.get(key, lag + 1) > lag:
                found[key] = lag

    for place, k, head in zip(places, ranks, heads):
        i = place + tail
        if i != last + 1:
            for lag, first in active.items():
                end(lag, first, last)
            active = {}
        # runs around this seed: (first place of a seed inside them, period)
        around = [(first - q, q) for q, first in active.items() if last - first + 1 >= q and w[i] == w[i - q]]
        if known:
            while next_known < len(known) and known[next_known][0] <= place:
                inside.append(known[next_known])
                next_known += 1
            inside = [r for r in inside if r[1] >= i]
            around += [(s, p) for s, _, p in inside]
        new: dict[int, int] = {}
        k = bisect_right(order, place - low, head, k) - 1
        while k >= head and place - order[k] < high:
            j = order[k]
            for s, q in around:
                if s <= j <= place - 2 * q:
                    k = bisect_left(order, s, head, k) - 1
                    break
            else:
                lag = place - j
                first = active.pop(lag, None)
                if first is None and i > done.get(lag, -1):
                    first = place
                    while first > lag and w[first - 1] == w[first - 1 - lag]:
                        first -= 1
                if first is not None:
                    new[lag] = first
                k -= 1
        for lag, first in active.items():
            end(lag, first, i - 1)
        active, last = new, i
    for lag, first in active.items():
        end(lag, first, last)


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Words that no run repeats: those outside every run's part after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, length, p in found:
        edge[s + p] += 1
        edge[s + length] -= 1
    return np.cumsum(edge)[:n] == 0


def find(docs: DataFrame) -> DataFrame:
    """Periodic runs of words in every whole text and the text without their repetitions.

    Input: doc_id, text; other columns are ignored. Output per input row: doc_id, n_words, runs (array of start, length,
    period in words from 0, by start, then period), collapsed (the words that are not inside any run after its first
    period, joined by one space). A run is a longest stretch of at least max(12, 2 x period) words with its smallest
    period. Null and empty text have no words and no runs; a null doc_id stays null; repeated rows are rows of their own;
    an empty table gives an empty result. No row leaves its task, so no key can be hot.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for part in T.slices(batch):
                count, all_runs, texts = [], [], []
                for text in part.column("text").to_pylist():
                    ws = words(text)
                    number: dict[bytes, int] = {}
                    codes = np.fromiter((number.setdefault(x, len(number)) for x in ws), np.int64, len(ws))
                    r = runs(codes)
                    if r:
                        keep = kept_words(len(ws), r)
                        ws = [x for x, k in zip(ws, keep.tolist()) if k]
                    count.append(len(codes))
                    all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in r])
                    texts.append(b" ".join(ws).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(count, pa.int64()), pa.array(all_runs, pa.list_(struct)), pa.array(texts, pa.string())],
                                                 ["doc_id", "n_words", "runs", "collapsed"])

    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return x.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
