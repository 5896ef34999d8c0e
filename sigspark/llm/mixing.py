"""Entropy balancing of sources: document rates that meet token targets.

Document i of source s with size z_i (its tokens) gets the rate r_i = min(cap, exp(lambda_s z_i / mean_s)). These are the
rates nearest to 1 in Kullback-Leibler distance under the token constraints sum r_i z_i = target_s and r_i <= cap; lambda
solves the convex dual. Rates depend on source and size only, so documents are first counted by (source, size), and every
Newton iteration is one aggregation over that table, with lambda kept in a bracket so that it always converges.

Rates become copies in two steps. The copies of each (source, size) cell are rounded from the largest size down, what one
cell is short of goes into the next; then the documents of a cell, ranked by a hash of their id, take the cell's copies
evenly. A source has at most sqrt(2 x its tokens) cells, since k different sizes add up to k^2 / 2 tokens at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from . import text as T
from .common import ranked, row_hash, settled, spread_join, written

CAP = 3
TOLERANCE = 1e-9
ROUNDS = 80


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of other characters than space and 09-0D), _h (hash for ties), _row (hash of the row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                data, offs = T.flat(part.column("text"))
                _, _, doc = T.word_spans(data, offs, T.NOT_SPACE)
                n = np.bincount(doc, minlength=part.num_rows) if len(doc) else np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(n.astype(np.int64)), part.column("_h"), part.column("_row")],
                                                 ["doc_id", "source", "size", "_h", "_row"])

    t = F.col("text").cast("string")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), t.alias("text"),
                    F.xxhash64(F.lit("mix"), "doc_id").alias("_h"), row_hash(docs).alias("_row"))
    return x.mapInArrow(run, "doc_id long, source string, size long, _h long, _row long")


def targets(source_sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """source, source_size, target. Sources in code-point order, null last, take `weights` in turn and share the total;
    a target stops at cap x source_size and the excess goes to the others by weight, until none is above."""
    # Spark compares strings by their UTF-8 bytes, which is code-point order
    place = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    x = written(source_sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1).cast("double")), "sources")
    total = float(x.agg(F.sum("source_size")).first()[0] or 0)
    most = F.col("source_size") * cap
    level = 0.0
    while True:
        full = most <= F.col("weight") * F.lit(level)
        r = x.agg(F.sum(F.when(full, most).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        new = max(level, (total - r["full"]) / r["open"])
        if new == level:
            break
        level = new
    return x.select("source", "source_size", F.least(most.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def balance(cells: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """source, target, source_size, mean, lam: Newton iterations on the dual. cells: source, size, n."""
    mean = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    x = goals.join(mean, same(goals, mean)).drop(mean["source"])
    # a source at the cap or without words has no finite lambda: its rate is the cap, or nothing is to be taken
    top = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    state = written(x.withColumn("done", top).withColumn("lam", F.when(top, F.lit(float("inf"))).otherwise(F.lit(0.0)))
                    .withColumn("lo", F.lit(None).cast("double")).withColumn("hi", F.lit(None).cast("double")), "lambda")
    for _ in range(ROUNDS):
        open_ = state.where("not done")
        j = cells.join(open_, same(cells, open_)).drop(cells["source"])
        z = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * z, F.lit(50.0))))
        tokens = F.col("size") * F.col("n")
        g = j.groupBy("source", "target", "source_size", "mean", "lam", "lo", "hi").agg(
            F.sum(tokens * rate).alias("got"), F.sum(F.when(rate < cap, tokens * z * rate).otherwise(0.0)).alias("slope"))
        low = F.when(F.col("got") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))
        high = F.when(F.col("got") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        g = g.withColumn("lo", low).withColumn("hi", high)
        step = F.when(F.col("slope") > 0, F.col("lam") - (F.col("got") - F.col("target")) / F.col("slope"))
        inside = (F.col("lo").isNull() | (step > F.col("lo"))) & (F.col("hi").isNull() | (step < F.col("hi")))
        far = F.greatest(F.lit(1.0), F.abs("lam")) * 2
        other = (F.when(F.col("lo").isNull(), F.col("lam") - far).when(F.col("hi").isNull(), F.col("lam") + far).otherwise((F.col("lo") + F.col("hi")) / 2))
        done = F.abs(F.col("got") - F.col("target")) <= F.col("target") * TOLERANCE
        g = g.withColumn("done", done).withColumn("lam", F.when(done, F.col("lam")).when(inside, step).otherwise(other))
        state = written(state.where("done").select(*state.columns).union(g.select(*state.columns)), "lambda")
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "source_size", "target", "mean", "lam")


def _rounded(cap: int):
    def run(key, t: pd.DataFrame) -> pd.DataFrame:
        """Copies of the cells of one source."""
        t = t.sort_values("size", ascending=False)
        size, n = t["size"].to_numpy(), t["n"].to_numpy()
        lam, mean = float(t["lam"].iloc[0]), float(t["mean"].iloc[0])
        with np.errstate(over="ignore", invalid="ignore"):
            rate = np.full(len(t), float(cap)) if np.isinf(lam) else np.minimum(cap, np.exp(np.minimum(lam * size / max(mean, 1e-300), 50)))
        copies, carry = np.zeros(len(t), np.int64), 0.0
        for i in range(len(t)):
            if size[i] == 0:
                copies[i] = n[i]
                continue
            want = rate[i] * n[i] * size[i] + carry
            copies[i] = min(max(round(want / size[i]), 0), cap * n[i])
            carry = want - float(copies[i]) * size[i]
        return pd.DataFrame({"source": t["source"], "size": size, "n": n, "copies": copies, "target": t["target"], "source_size": t["source_size"]})
    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Copies of every document in the mix.

    Input: doc_id, text, source. Output per input row: doc_id, source, size, source_size, target (of its source), copies.
    No document has more than `cap` copies. Null text has size 0; documents of size 0 are kept once and count nothing; a
    null source is a source of its own and the last; documents of one source and size take copies in the order of a hash
    of their id, rows of equal id in any order, so equal inputs give equal results. Other columns are ignored; an empty
    table gives an empty result.
    """
    d = written(sizes(docs), "sizes")
    cells = written(d.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    goals = written(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap), "targets")
    rates = balance(cells, goals, cap)
    x = cells.join(rates, cells["source"].eqNullSafe(rates["source"])).drop(rates["source"])
    x = x.groupBy("source").applyInPandas(_rounded(cap), "source string, size long, n long, copies long, target double, source_size long")
    part = F.shiftrightunsigned("_h", 58)
    keyed = d.withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))})
    r = ranked(keyed, ["_null", "_source", "size"], part, ["_h", "doc_id"])
    x = x.withColumns({"_null": F.col("source").isNull(), "_source": F.coalesce("source", F.lit(""))}).drop("source")
    y = spread_join(r, x.withColumn("_cell", F.col("n")), ["_null", "_source", "size"], "_cell", int(cells.agg(F.sum("n")).first()[0] or 0))
    extra = F.col("copies") % F.col("n")
    # spread the remainder over the ranks, whatever their number
    more = F.floor((F.col("_rank") + 1) * extra / F.col("n")) - F.floor(F.col("_rank") * extra / F.col("n"))
    return y.select("doc_id", "source", "size", "source_size", "target", (F.floor(F.col("copies") / F.col("n")) + more).cast("long").alias("copies"), "_h", "_row")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP) -> DataFrame:
    """Documents repeated as often as the mix takes them; columns as given. A row is matched by all its columns, so rows
    that share an id, or have none, get their own copies; rows that are equal in every column are one row that comes as
    often as the mix takes all of them."""
    m = settled(docs.sparkSession, lambda: mix(docs, weights, cap), "copies")
    total = m.count()
    m = m.groupBy("_row").agg(F.sum("copies").alias("_mix_copies"), F.count(F.lit(1)).alias("_mix_rows")).where("_mix_copies > 0")
    m = m.withColumnRenamed("_row", "_mix_row")
    x = spread_join(docs.withColumn("_mix_row", row_hash(docs)), m, ["_mix_row"], "_mix_rows", total)
    again = x.where("_mix_rows > 1").dropDuplicates(["_mix_row"])
    x = x.where("_mix_rows = 1").union(again)
    return x.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))).alias("_mix_copy")).drop("_mix_copy")
