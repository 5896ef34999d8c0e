"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of every whole text (shares of character classes, word lengths, repetition) in one Arrow pass.
2. Boosted shallow trees are grown on a bounded sample of labelled documents; every path from a root to a node is a rule,
   a conjunction of thresholds.
3. A lasso logistic regression on the rules drops most of them and weighs the rest.
4. The rules that are left are compiled into one Spark column expression, so scoring is a projection.

Labels, language, source and ids are no statistics. The fit sees at most `MAX_ROWS` labelled rows: those with the smallest
hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as S

from . import text as T

MAX_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 32
RATE = 0.3
PENALTY = 0.002
THRESHOLD = 0.3

STATS = ["log_words", "word_length", "long_words", "upper", "digits", "symbols", "bars", "bangs", "stops", "beyond_ascii", "newlines",
         "distinct_words", "top_word", "repeats", "distinct_triples", "capitalised"]

_U = np.uint64
#: byte classes: 1 upper, 2 digit, 3 symbol, 4 bar, 5 bang, 6 full stop or comma, 7 beyond ASCII, 8 newline
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91], _CLASS[48:58], _CLASS[128:], _CLASS[10] = 1, 2, 7, 8
_CLASS[[ord(c) for c in "#$%&*@^~<>{}[]\\=+_/"]] = 3
_CLASS[ord("|")], _CLASS[ord("!")], _CLASS[[ord("."), ord(",")]] = 4, 5, 6


def _runs(own: np.ndarray, h: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the size of the largest group of equal values per document."""
    key = (own.astype(np.uint64) << _U(52)) | (h >> _U(12))
    key.sort()
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    doc = (key[start] >> _U(52)).astype(np.int64)
    top = np.zeros(docs, np.int64)
    np.maximum.at(top, doc, size)
    return np.bincount(doc, minlength=docs), top


def statistics(column) -> np.ndarray:
    """One row of `STATS` per text; an empty or null text has zeros."""
    data, offs = T.flat(column)
    docs = len(offs) - 1
    size = np.diff(offs)
    own = np.repeat(np.arange(docs), size)
    count = np.bincount(own * 9 + _CLASS[data], minlength=docs * 9).reshape(docs, 9) / np.maximum(size, 1)[:, None]
    low = T.LOWER[data]
    s, e, doc = T.word_spans(low, offs, T.NOT_SPACE)
    h = T.word_hashes(low, s, e)
    words = np.bincount(doc, minlength=docs) if len(doc) else np.zeros(docs, np.int64)
    per = lambda x: np.bincount(doc, weights=x, minlength=docs) / np.maximum(words, 1) if len(doc) else np.zeros(docs)
    distinct, top = _runs(doc, h, docs)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    tri = T.rolling(h, 3)
    inside = doc[:len(tri)] == doc[len(doc) - len(tri):] if len(tri) else np.zeros(0, bool)
    triples, _ = _runs(doc[:len(tri)][inside], tri[inside], docs)
    n_tri = np.maximum(words - 2, 0)
    first = data[s] if len(s) else data[:0]
    out = np.stack([
        np.log1p(words), per((e - s).astype(float)), per((e - s > 15).astype(float)), count[:, 1], count[:, 2], count[:, 3], count[:, 4], count[:, 5], count[:, 6],
        count[:, 7], count[:, 8], distinct / np.maximum(words, 1), top / np.maximum(words, 1), per(same.astype(float)), triples / np.maximum(n_tri, 1),
        per(((first >= 65) & (first < 91)).astype(float))], axis=1)
    return out


@F.arrow_udf(S.StructType([S.StructField(s, S.DoubleType()) for s in STATS]))
def text_statistics(text: pa.Array) -> pa.Array:
    parts = [statistics(p.column("text")) for p in T.slices(pa.RecordBatch.from_arrays([text], ["text"]))]
    x = np.concatenate(parts) if parts else np.zeros((0, len(STATS)))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(STATS))], STATS)


# ---------------------------------------------------------------- rules and weights

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is at most, threshold), all must hold


@dataclass
class Ensemble:
    """score = sigmoid(bias + sum of the weights of the rules that hold)."""
    bias: float
    rules: list[Rule]
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + fires(self.rules, x) @ self.weights)))

    def column(self, stats: str) -> Column:
        z = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights):
            hold = F.lit(True)
            for f, at_most, t in rule:
                c = F.col(f"{stats}.{STATS[f]}")
                hold = hold & ((c <= t) if at_most else (c > t))
            z = z + F.when(hold, float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def fires(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), np.float64)
    for j, rule in enumerate(rules):
        for f, at_most, t in rule:
            out[:, j] *= (x[:, f] <= t) if at_most else (x[:, f] > t)
    return out


def _tree(bins: np.ndarray, edges: list[np.ndarray], g: np.ndarray, hess: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """A regression tree on gradients by histograms: the rules of its nodes and the fitted value of every row."""
    rules: list[Rule] = []
    value = np.zeros(len(g))

    def grow(rows: np.ndarray, path: Rule, depth: int):
        value[rows] = g[rows].sum() / (hess[rows].sum() + 1.0)
        if path:
            rules.append(path)
        if depth == DEPTH or len(rows) < 40:
            return
        best = (1e-6, -1, -1)
        G, H = g[rows].sum(), hess[rows].sum()
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            gl, hl = np.cumsum(np.bincount(b, g[rows], BINS))[:-1], np.cumsum(np.bincount(b, hess[rows], BINS))[:-1]
            n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
            gain = gl ** 2 / (hl + 1) + (G - gl) ** 2 / (H - hl + 1) - G ** 2 / (H + 1)
            gain[(n < 20) | (len(rows) - n < 20)] = 0
            c = int(np.argmax(gain))
            if gain[c] > best[0]:
                best = (gain[c], f, c)
        _, f, c = best
        if f < 0:
            return
        left = bins[rows, f] <= c
        t = float(edges[f][min(c, len(edges[f]) - 1)])
        grow(rows[left], path + ((f, True, t),), depth + 1)
        grow(rows[~left], path + ((f, False, t),), depth + 1)

    grow(np.arange(len(g)), (), 0)
    return rules, value


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    rng, z, rules = np.random.default_rng(7), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        some = np.flatnonzero(rng.random(len(y)) < 0.7)
        found, _ = _tree(bins[some], edges, (y - p)[some], (p * (1 - p))[some])
        value = np.zeros(len(y))
        for r in found:  # deeper nodes come after their parents and overwrite them
            on = fires([r], x)[:, 0] > 0
            value[on] = (y - p)[on].sum() / ((p * (1 - p))[on].sum() + 1.0)
        z = z + RATE * np.clip(value, -4, 4)
        rules.update(dict.fromkeys(found))
    return list(rules)


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute-value penalty, by accelerated proximal gradient; the bias is free."""
    n = len(y)
    a1 = np.hstack([np.ones((n, 1)), a])
    v = np.random.default_rng(1).random(a1.shape[1])
    for _ in range(20):
        v = a1.T @ (a1 @ v)
        v /= np.linalg.norm(v)
    step = 4 * n / max(float(v @ (a1.T @ (a1 @ v))), 1e-9)
    w = np.zeros(a1.shape[1])
    w[0] = np.log(y.mean() / (1 - y.mean()))
    u, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a1 @ u, -40, 40)))
        new = u - step * (a1.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """With one class only, or no rows, the score is the smoothed share of label 1."""
    if len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(float(np.log(p / (1 - p))), [], np.zeros(0))
    rules = grow_rules(x, y)
    bias, w = lasso(fires(rules, x), y)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble(bias, [rules[i] for i in keep], w[keep])


# ---------------------------------------------------------------- the operator

def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Ensemble:
    """Fit on at most `max_rows` labelled ids, none of them held out. Several labels of an id count by their majority,
    several rows of an id as one."""
    t = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(~held_out())
    t = t.groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("_y"))
    t = t.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    x = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    x = x.join(F.broadcast(t), "_id")  # max_rows rows whatever the input
    x = x.select("_id", "_y", text_statistics("_text").alias("_q")).select("_id", "_y", "_q.*")
    x = x.groupBy("_id", "_y").agg(F.min(F.struct(*STATS)).alias("_q")).select("_id", "_y", "_q.*").orderBy("_id")
    got = x.toArrow()
    a = np.stack([got.column(s).to_numpy() for s in STATS], axis=1) if got.num_rows else np.zeros((0, len(STATS)))
    return fit(a, got.column("_y").to_numpy())


def score(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Quality of every whole text.

    Input: documents with doc_id, text; labels with doc_id, quality. Output per input row: doc_id, held_out, score (0 to 1,
    higher: label 1 likelier), predicted (1 from a score of 0.3), and the statistics as struct `stats`. Null and empty
    texts have the statistics of a text without words and get a score. A null doc_id is not held out. Repeated rows get
    equal scores; other columns are ignored; without labels the score is 0.5; an empty table gives an empty result.
    """
    model = train(docs, labels, max_rows)
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_statistics(F.col("text").cast("string")).alias("stats"))
    x = x.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), model.column("stats").alias("score"), "stats")
    return x.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "stats")


def accepted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Documents that the classifier does not reject; columns and rows as given."""
    model = train(docs, labels, max_rows)
    x = docs.withColumn("_quality_stats", text_statistics(F.col("text").cast("string")))
    return x.where(model.column("_quality_stats") >= THRESHOLD).select(*docs.columns)
