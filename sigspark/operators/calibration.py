"""Isotonic calibration, reliability, precision thresholds and frozen splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import ratio
from .partitioning import FINE, numbered, prefix_sums, value_bucket

# fixed values
MIN_COUNT, PRECISION = 8, 0.97


def score_table(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """One row per distinct score with its mean outcome and weight."""
    return df.groupBy(*keys, F.col(score).alias("x")).agg(F.avg(F.col(label).cast("double")).alias("y"),
                                                         F.count(F.lit(1)).cast("double").alias("w"))


def pools(y: np.ndarray, w: np.ndarray) -> tuple[list[float], list[float], list[int]]:
    """Weighted non-decreasing fit of values already in score order: level, weight and size of each pool."""
    level, weight, size = [], [], []
    for v, c in zip(y, w):
        level.append(v), weight.append(c), size.append(1)
        while len(level) > 1 and level[-2] > level[-1]:
            t = weight[-2] + weight[-1]
            level[-2] = (level[-2] * weight[-2] + level[-1] * weight[-1]) / t
            weight[-2], size[-2] = t, size[-2] + size[-1]
            level.pop(), weight.pop(), size.pop()
    return level, weight, size


def pool_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    level, _, size = pools(y, w)
    return np.repeat(level, size)


#: distinct scores pooled in one task of the first step
RANGE_SCORES = 1 << 16


def isotonic_fit(df: DataFrame, keys: list[str], score: str, label: str, range_scores: int = RANGE_SCORES) -> DataFrame:
    """Knots (keys, x, y) for any number of scores. Tied scores are averaged first.

    Violators are pooled inside ranges of `range_scores` distinct scores, then the pools of all ranges of a key are pooled
    again, which gives the same fit. With 0/1 outcomes the pools of n rows are corners of a convex path on a grid, at most
    about n^(2/3) of them, and that is what the second step has in one task.
    """
    t = score_table(df, keys, score, label)
    t = numbered(t, keys, value_bucket(F.col("x"), FINE), ["x"], "_rn").withColumn("_range", F.floor((F.col("_rn") - 1) / range_scores)).drop("_rn")
    spec = ", ".join(f"{k} {dict(t.dtypes)[k]}" for k in keys)

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("x")
        level, weight, size = pools(p.y.to_numpy(), p.w.to_numpy())
        n = np.arange(len(level))
        return p[[*keys, "_range", "x"]].assign(_pool=np.repeat(n, size), _level=np.repeat(level, size), _weight=np.repeat(weight, size))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["_range", "_pool"])
        return p[[*keys, "_range", "_pool"]].assign(y=pool_violators(p._level.to_numpy(), p._weight.to_numpy()))

    x = t.groupBy(*keys, "_range").applyInPandas(inside, f"{spec}, _range long, x double, _pool long, _level double, _weight double")
    p = x.select(*keys, "_range", "_pool", "_level", "_weight").distinct()
    y = p.groupBy(*keys).applyInPandas(across, f"{spec}, _range long, _pool long, y double")
    return x.join(y, [*keys, "_range", "_pool"]).select(*keys, "x", "y")


CELLS = 1024


def isotonic_apply(rows: DataFrame, knots: DataFrame, keys: list[str], score: str, out: str = "calibrated") -> DataFrame:
    """Linear interpolation between the bracketing knots, clamped at both ends.

    Knot segments are copied to the score cells they meet (at most knots + 1,024 rows a key) and matched by
    equi-join on (keys, cell).
    """
    w = W.partitionBy(*keys).orderBy("x")
    inf = float("inf")
    seg = knots.withColumns({"x1": F.lead("x").over(w), "y1": F.lead("y").over(w), "_first": F.row_number().over(w) == 1})
    seg = seg.select(*keys, F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce("x1", F.lit(inf)).alias("x1"),
                     F.coalesce("y1", "y").alias("y1"), "_first")
    low = seg.where("_first").select(*keys, F.lit(-inf).alias("x0"), F.col("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    seg = seg.drop("_first").unionByName(low)
    cell = lambda c: F.least(F.greatest(F.floor(c * CELLS), F.lit(0)), F.lit(CELLS))
    lo = F.when(F.col("x0") == -inf, 0).otherwise(cell(F.col("x0")))
    hi = F.when(F.col("x1") == inf, CELLS).otherwise(cell(F.col("x1")))
    seg = seg.withColumn("_cell", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    r = rows.withColumn("_cell", cell(F.col(score)).cast("long"))
    j = r.join(seg, [*keys, "_cell"], "left").where((F.col(score) >= F.col("x0")) & (F.col(score) < F.col("x1")))
    flat = (F.col("x0") == -inf) | (F.col("x1") == inf)
    y = F.when(flat, F.col("y0")).otherwise(
        F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col(score) - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return j.withColumn(out, y).drop("_cell", "x0", "x1", "y0", "y1")


def reliability_table(df: DataFrame, keys: list[str], score: str, label: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(*keys, b.alias("bin")).agg(
        F.avg(score).alias("mean_confidence"), F.avg(F.col(label).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("count"))


def ece(table: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence"))
    return table.groupBy(*keys).agg((F.sum(F.col("count") * gap) / F.sum("count")).alias("ece"))


def calibration_report(df: DataFrame, key: str, score: str, label: str) -> DataFrame:
    """Per key: fit on train, ECE raw and calibrated on test, plus knot counts of the fit on all rows."""
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    cal = isotonic_apply(test, isotonic_fit(train, [key], score, label), [key], score)
    raw = ece(reliability_table(test, [key], score, label), [key]).withColumnRenamed("ece", "ece_raw")
    fit = ece(reliability_table(cal, [key], "calibrated", label), [key]).withColumnRenamed("ece", "ece_calibrated")
    full = isotonic_fit(df, [key], score, label).groupBy(key).agg(F.count(F.lit(1)).alias("knots"))
    return raw.join(fit, key, "left").join(full, key)


def precision_threshold(df: DataFrame, keys: list[str], value: str, ok: Column, min_count: int = MIN_COUNT,
                        precision: float = PRECISION) -> DataFrame:
    """Smallest value with enough rows at or above it at the wanted precision, moved to the midpoint below it.

    Works on distinct values; the tail count is total minus a bucketed running sum.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, F.round(value, 6).alias("_x")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(ok).alias("_k"))
    v = prefix_sums(v.withColumn("_bk", value_bucket(F.col("_x"), FINE)), keys, "_bk", ["_x"], _cn=F.col("_n"), _ck=F.col("_k"))
    tot = v.groupBy(*keys).agg(F.sum("_n").alias("_tn"), F.sum("_k").alias("_tk"))
    j = v.join(tot, keys)
    n, k = F.col("_tn") - F.col("_cn") + F.col("_n"), F.col("_tk") - F.col("_ck") + F.col("_k")
    first = j.groupBy(*keys).agg(F.min(F.when((n >= min_count) & (k / n >= precision), F.col("_x"))).alias("_th"))
    prev = j.join(first, keys).groupBy(*keys, "_th").agg(F.max(F.when(F.col("_x") < F.col("_th"), F.col("_x"))).alias("_p"))
    return prev.select(*keys, F.when(F.col("_th").isNull(), F.lit(float("inf")))
                       .otherwise(F.coalesce((F.col("_p") + F.col("_th")) / 2, F.col("_th"))).alias("threshold"))


def stratified_split(entries: DataFrame, force_test: list[str]) -> DataFrame:
    """Protocols of a stratum in hash order: even ones test, odd ones calibration; forced ones test."""
    p = entries.select("stratum", "protocol").distinct().withColumn("_h", F.sha2("protocol", 256))
    free = numbered(p.where(~F.col("protocol").isin(force_test)), ["stratum"],
                    F.conv(F.substring("_h", 1, 3), 16, 10).cast("long"), ["_h", "protocol"], "_rn")
    side = free.select("stratum", "protocol", F.when(F.col("_rn") % 2 == 1, "test").otherwise("calibration").alias("split"))
    forced = p.where(F.col("protocol").isin(force_test)).select("stratum", "protocol", F.lit("test").alias("split"))
    return entries.join(side.unionByName(forced), ["stratum", "protocol"])


def split_digest(entries: DataFrame, key: str, size: int = 256) -> DataFrame:
    """Digest of the sorted (id, split) list as a tree: ids in ranges of `size`, ranges in groups of `size`, then all."""
    joined = lambda fields, item, sep: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), item), sep), 256)
    d = entries.groupBy(F.floor(F.col(key) / size).alias("_k")).agg(
        joined([key, "split"], lambda s: F.concat_ws(":", s[key].cast("string"), s["split"]), ",").alias("_d"))
    d = d.groupBy(F.floor(F.col("_k") / size).alias("_g")).agg(joined(["_k", "_d"], lambda s: s["_d"], "").alias("_d"))
    return d.agg(joined(["_g", "_d"], lambda s: s["_d"], "").alias("digest"))


#: stands for a margin without a rival; thresholds of this size are reported as infinite
NO_RIVAL = 1e300


def staged_fit(decisions: DataFrame, unit: str = "sample", min_usage: float = 0.01, min_count: int = MIN_COUNT,
               precision: float = PRECISION) -> DataFrame:
    """Thresholds of the publication gates, one after the other, each on the decisions that pass the ones before.

    `decisions` (written or cheap to read, it is read once per stage): the columns of `hypotheses.mdl_winner`, `gen`, and
    the outcomes ok_label (label is true), ok_fm (truth is FM), ok_rate (rate is true). A threshold is the largest one over
    the generations. Order: family margin, margin of FM over digital, unexplained share (95th percentile of the right
    ones), margin over other labels, rate margin. One row: the thresholds and `coverage`, the right labels and rates
    that are published under them. Each stage is one aggregation; what comes back from it is a scalar.
    """
    from .hypotheses import DIGITAL, UNKNOWN_CE
    from .partitioning import quantiles
    spark = decisions.sparkSession
    c, no = F.col, F.lit(False)
    scale = {"sample": F.lit(1.0), "symbol": c("fs") / c("best_rate"), "total": c("n_samples").cast("double")}[unit]
    ok = lambda x: F.coalesce(x, no)
    scaled = {f"_{m}": F.when(c(m) == float("inf"), NO_RIVAL).otherwise(c(m) * scale) for m in ("m_fam", "m_fm_digital", "m_label", "m_rate")}
    x = decisions.withColumns(scaled)

    def pick(rows: DataFrame, value: str, right: str, empty: float) -> float:
        t = precision_threshold(rows.select("gen", value, right), ["gen"], value, c(right), min_count, precision)
        every = decisions.select("gen").distinct().join(t, "gen", "left").agg(F.max(F.coalesce("threshold", F.lit(empty))).alias("t"))
        th = every.first()["t"]
        return float("inf") if th is None or th >= NO_RIVAL / 4 else float(th)

    inf = float("inf")
    x = x.where(ok((c("best_family") != "none") & (c("best_family") != UNKNOWN_CE) & (c("best_usage") >= min_usage)))
    fam = pick(x, "_m_fam", "ok_label", inf)
    x = x.where(ok(c("_m_fam") >= fam))
    fm = pick(x.where("best_label = 'FM'"), "_m_fm_digital", "ok_fm", 0.0)
    x = x.where((c("best_label") != "FM") | ok(c("_m_fm_digital") >= fm))
    right = x.where(ok(c("ok_label")) & c("unexplained").isNotNull())
    q = quantiles(right.select("unexplained"), [], "unexplained", {"q": 0.95}).first()
    unexplained = float(q["q"]) if q is not None and q["q"] is not None else 1.0
    x = x.where(ok(c("unexplained") <= unexplained))
    lab = pick(x, "_m_label", "ok_label", 0.0)
    x = x.where(ok(c("_m_label") >= lab))
    rated = x.where(c("best_expert").isin(*DIGITAL))
    rate = pick(rated, "_m_rate", "ok_rate", inf)
    good = x.agg(F.count_if(ok(c("ok_label")))).first()[0] + rated.agg(F.count_if(ok(c("ok_rate") & (c("_m_rate") >= rate)))).first()[0]
    row = (unit, fam, rate, unexplained, fm, lab, int(good))
    return spark.createDataFrame([row], "unit string, m_fam double, m_rate double, unexplained_max double, m_fm_digital double, m_label double, coverage long")


def unknown_wrong(gated: DataFrame, truth: Column, unknown: list[str]) -> DataFrame:
    """Share of captures of families outside the library that got a label all the same; NULL without any."""
    return gated.where(truth.isin(*unknown)).agg(F.count(F.lit(1)).alias("n"), F.count_if("label_published").alias("n_wrong"),
                                                 ratio(F.count_if("label_published"), F.count(F.lit(1))).alias("share"))
