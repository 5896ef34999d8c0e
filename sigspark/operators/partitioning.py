"""Ordered computations that stay parallel inside one large key.

A capture may hold a third of all samples, so nothing here puts a whole key in one window partition.
Rows are cut into position (or value) buckets; one small row per bucket carries what crosses its edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import written

BLOCK = 1 << 16
#: rows of one key that one task may own
WHOLE = 1 << 16


def by_size(df: DataFrame, keys: list[str], most: int = WHOLE) -> tuple[DataFrame, DataFrame | None]:
    """The rows of keys with at most `most` rows, which one task may own, and the rows of the others; None when there are
    no others. Keys are counted first, so this runs a job; the list of large keys is at most a row in `most` rows."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    large = written(n.where(F.col("_n") > most).select(*keys))
    if large.isEmpty():
        return df, None
    same = [df[k].eqNullSafe(large[k]) for k in keys]
    return df.join(F.broadcast(large), same, "left_anti"), df.join(F.broadcast(large), same, "left_semi")


def halo(df: DataFrame, keys: list[str], pos: str, block: int, left: int, right: int,
         out: str = "_hb") -> DataFrame:
    """Copy each row into every block whose [start - left, end + right) covers it.

    `core` marks the one copy that lies inside its block; windows with frames of at most left/right rows
    over (keys, block) are then exact on core rows.
    """
    p = F.col(pos)
    first = F.floor((p - right) / block)
    last = F.floor((p + left) / block)
    return (df.withColumn(out, F.explode(F.sequence(first, last)))
              .withColumn("core", F.floor(p / block) == F.col(out)))


def halo_window(keys: list[str], pos: str, out: str = "_hb"):
    return W.partitionBy(*keys, out).orderBy(pos)


def _offsets(totals: DataFrame, keys: list[str], bucket: str, sums: list[str], maxs: list[str]) -> DataFrame:
    """Per bucket: what all earlier buckets of the key add up to."""
    w = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(bucket) \
        .rowsBetween(W.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_o_{c}") for c in sums]
    cols += [F.max(c).over(w).alias(f"_o_{c}") for c in maxs]
    return totals.select(*keys, bucket, *cols)


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list, **sums: Column) -> DataFrame:
    """Inclusive running sums in (bucket, order) order, one task per (keys, bucket).

    `bucket` must not decrease along `order`. Ties in `order` share no value: the order must be total.
    """
    names = list(sums)
    base = df.withColumns({f"_v_{c}": e for c, e in sums.items()})
    totals = base.groupBy(*keys, bucket).agg(*[F.sum(f"_v_{c}").alias(c) for c in names])
    off = _offsets(totals, keys, bucket, names, [])
    w = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (base.join(off, [*keys, bucket])
                .withColumns({c: F.sum(f"_v_{c}").over(w) + F.col(f"_o_{c}") for c in names})
                .drop(*[f"_v_{c}" for c in names], *[f"_o_{c}" for c in names]))


FINE = 64 * 256


def value_bucket(c: Column, per_fold: int = 64, scale: float = 1e6) -> Column:
    """Order-preserving coarse code of a double: log-spaced, `per_fold` buckets per e-fold."""
    return F.floor(F.signum(c) * F.log1p(F.abs(c) * scale) * per_fold).cast("long")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict) -> DataFrame:
    """Exact linear-interpolated quantiles of any number of rows per key. NULLs are ignored. A function in place of a
    share gives the 0-based rank from the number of values.

    Equal values are counted first, map-side combined, so a value that very many rows share is one row, and each row is
    shuffled once. The counts go into two levels of log-spaced buckets; only the values of the few buckets that hold a
    wanted rank are then looked at one by one, so no key is ever gathered in one task.
    """
    x = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    x = x.withColumn("_b1", value_bucket(F.col("_x"))).withColumn("_b2", value_bucket(F.col("_x"), 64 * 4096))
    ranks = {name: p(F.col("_total")) if callable(p) else F.lit(p) * (F.col("_total") - 1) for name, p in probs.items()}

    def wanted(start: str, end: str) -> Column:
        cond = F.lit(False)
        for rk in ranks.values():
            cond = cond | ((F.col(start) <= F.ceil(rk)) & (F.col(end) > F.floor(rk)))
        return cond

    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    upto = (W.unboundedPreceding, 0)
    c2 = x.groupBy(*keys, "_b1", "_b2").agg(F.sum("_n").alias("_n"))
    c1 = c2.groupBy(*keys, "_b1").agg(F.sum("_n").alias("_n"))
    c1 = (c1.withColumn("_end", F.sum("_n").over(part.orderBy("_b1").rowsBetween(*upto)))
            .withColumn("_total", F.sum("_n").over(part)).withColumn("_base", F.col("_end") - F.col("_n"))
            .where(wanted("_base", "_end")).select(*keys, "_b1", "_base", "_total"))
    c2 = (c2.join(c1, [*keys, "_b1"])
            .withColumn("_end", F.col("_base") + F.sum("_n").over(W.partitionBy(*keys, "_b1").orderBy("_b2").rowsBetween(*upto)))
            .withColumn("_from", F.col("_end") - F.col("_n")).where(wanted("_from", "_end"))
            .select(*keys, "_b1", "_b2", "_from", "_total"))
    fine = x.join(c2, [*keys, "_b1", "_b2"])
    fine = (fine.withColumn("_end", F.col("_from") + F.sum("_n").over(
                W.partitionBy(*keys, "_b1", "_b2").orderBy("_x").rowsBetween(*upto)))
                .withColumn("_start", F.col("_end") - F.col("_n")))
    aggs = []
    for name, rk in ranks.items():
        lo = F.max(F.when((F.col("_start") <= F.floor(rk)) & (F.col("_end") > F.floor(rk)), F.col("_x")))
        hi = F.max(F.when((F.col("_start") <= F.ceil(rk)) & (F.col("_end") > F.ceil(rk)), F.col("_x")))
        frac = F.max(rk - F.floor(rk))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return fine.groupBy(*keys).agg(*aggs)


def interval_groups(df: DataFrame, keys: list[str], lo: str, hi: str, gap: int | Column = 0, block: float | None = BLOCK) -> DataFrame:
    """Distinct half-open intervals with `_n` (rows) and `_g`: two of one key are in one group when lo <= reach + gap.

    With `block`, the running reach is carried across position blocks by one row per block. `block=None` is for keys whose
    group size is bounded (spectral bins, one block's runs).
    """
    base = (df.groupBy(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
              .agg(F.count(F.lit(1)).alias("_n")))
    g = gap if isinstance(gap, Column) else F.lit(gap)
    if block is None:
        before = W.partitionBy(*keys).orderBy("_lo", "_hi").rowsBetween(W.unboundedPreceding, -1)
        upto = W.partitionBy(*keys).orderBy("_lo", "_hi").rowsBetween(W.unboundedPreceding, 0)
        x = base.withColumn("_reach", F.max("_hi").over(before))
        x = x.withColumn("_new", (F.col("_reach").isNull() | (F.col("_lo") > F.col("_reach") + g)).cast("long"))
        return x.withColumn("_g", F.sum("_new").over(upto))
    base = base.withColumn("_blk", F.floor(F.col("_lo") / block))
    tot = base.groupBy(*keys, "_blk").agg(F.max("_hi").alias("_reach0"))
    off = _offsets(tot, keys, "_blk", [], ["_reach0"])
    before = W.partitionBy(*keys, "_blk").orderBy("_lo", "_hi").rowsBetween(W.unboundedPreceding, -1)
    x = base.join(off, [*keys, "_blk"])
    x = x.withColumn("_reach", F.greatest(F.max("_hi").over(before), F.col("_o__reach0")))
    x = x.withColumn("_new", (F.col("_reach").isNull() | (F.col("_lo") > F.col("_reach") + g)).cast("long"))
    return prefix_sums(x, keys, "_blk", ["_lo", "_hi"], _g=F.col("_new"))


def merge_intervals(df: DataFrame, keys: list[str], lo: str, hi: str, gap: int | Column = 0,
                    block: int | None = BLOCK) -> DataFrame:
    """Union of half-open intervals; output: keys, lo, hi, `n` merged. See `interval_groups`."""
    x = interval_groups(df, keys, lo, hi, gap, block)
    return (x.groupBy(*keys, "_g").agg(F.min("_lo").alias(lo), F.max("_hi").alias(hi),
                                       F.sum("_n").alias("n")).drop("_g"))


def runs(df: DataFrame, keys: list[str], pos: str, block: int | None = BLOCK, gap: int = 0) -> DataFrame:
    """Maximal runs of the given positions as [start, end)."""
    pts = df.select(*keys, F.col(pos).alias("start"), (F.col(pos) + 1).alias("end"))
    return merge_intervals(pts, keys, "start", "end", gap, block)


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, lo: str, hi: str,
                      width: int, how: str = "inner") -> DataFrame:
    """Equi-join on (keys, position bin) plus the exact bounds; each interval is copied once per bin it meets."""
    last = F.greatest(F.floor((F.col(hi) - 1) / width), F.floor(F.col(lo) / width))
    iv = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), last)))
    iv = iv.withColumnRenamed(lo, "_lo").withColumnRenamed(hi, "_hi")
    pt = points.withColumn("_bin", F.floor(F.col(pos) / width))
    cond = [pt[k] == iv[k] for k in keys] + [pt["_bin"] == iv["_bin"],
                                             pt[pos] >= iv["_lo"], pt[pos] < iv["_hi"]]
    j = pt.join(iv, cond, how)
    for k in keys:
        j = j.drop(iv[k])
    return j.drop(iv["_bin"]).drop("_bin").withColumnRenamed("_lo", lo).withColumnRenamed("_hi", hi)


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "rn") -> DataFrame:
    """1-based row number in `order` without one task per key; `bucket` must not decrease along `order`."""
    x = df.withColumn("_bk", bucket)
    return prefix_sums(x, keys, "_bk", order, **{name: F.lit(1).cast("long")}).drop("_bk")
