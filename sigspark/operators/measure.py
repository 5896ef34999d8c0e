"""Per-region measurements on short spectra: one row per region with its power array.

A region's array has at most one entry per spectral bin, so array expressions stay bounded; sums and moments of
samples are plain aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import EPS, db

CAVEAT = "unshaped-pulse-sidelobes"
# fixed values
OVERSAMPLE, MIN_SAMPLES = 4, 2000


def region_arrays(psd: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Long (keys, bin, power) -> one row with `power` in bin order and its `first_bin`."""
    g = psd.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "power"))).alias("_s"),
                               *[F.first(c).alias(c) for c in (extra or [])])
    return g.withColumn("first_bin", F.col("_s")[0]["bin"].cast("long")) \
            .withColumn("power", F.transform("_s", lambda s: s["power"])).drop("_s")


def centroid_frequency(psd: DataFrame, keys: list[str], freq: Column, floor: Column, tuning: Column) -> DataFrame:
    e = F.greatest(F.col("power") - floor, F.lit(0.0))
    a = psd.groupBy(*keys).agg((F.sum(freq * e) / F.nullif(F.sum(e), F.lit(0.0))).alias("_c"),
                               F.sum(e).alias("excess"), F.first(tuning).alias("_t"))
    return a.select(*keys, "excess", (F.col("_c") + F.coalesce("_t", F.lit(0.0))).alias("center_frequency_hz"))


def snr_db(on_power: Column, floor: Column, rate: float) -> Column:
    """NULL when the occupied power does not exceed the noise power."""
    off = floor * rate
    return F.when(on_power > off, 10.0 * F.log10((on_power - off) / off))


def half_power_width(p: Column, step: float) -> Column:
    """Connected half-power lobe around the (first) peak, crossings interpolated; NULL when an edge is not observed."""
    k = F.array_position(p, F.array_max(p)) - 1
    half = F.array_max(p) / 2
    n = F.size(p)
    low = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.get(p, j) < half)
    left = F.array_max(F.filter(low, lambda j: j < k))
    right = F.array_min(F.filter(low, lambda j: j > k))
    lo = left + (half - F.get(p, left)) / (F.get(p, left + 1) - F.get(p, left))
    hi = right - (half - F.get(p, right)) / (F.get(p, right - 1) - F.get(p, right))
    return F.when((n >= 3) & (F.array_max(p) > 0), (hi - lo) * step)


def box_smooth(p: Column, w: Column) -> Column:
    """Mean over w|1 bins, zeros outside, by slices of the array."""
    h = F.floor(w / 2).cast("int")
    width = (2 * h + 1).cast("double")
    n = F.size(p)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.aggregate(
        F.slice(p, F.greatest(b - h, F.lit(0)) + 1, F.least(b + h, n - 1) - F.greatest(b - h, F.lit(0)) + 1),
        F.lit(0.0), lambda a, x: a + x) / width)


def smoothed_half_power_width(regions: DataFrame, step: float, rounds: int = 3, out: str = "bandwidth_3db_hz") -> DataFrame:
    """Half-power width of the excess array after smoothing by an eighth of the current width, three updates."""
    n = F.size("power")
    top = F.greatest(F.lit(3), F.floor(n / 4))
    x = regions.withColumn("_w", F.least(F.greatest(F.floor(n / 16), F.lit(3)), top)).withColumn("_bw", F.lit(None).cast("double"))
    x = x.withColumn("_dead", F.lit(False))
    for _ in range(rounds):
        x = x.withColumn("_sm", box_smooth(F.col("power"), F.col("_w")))
        x = x.withColumn("_bw", F.when(~F.col("_dead"), half_power_width(F.col("_sm"), step)))
        x = x.withColumn("_dead", F.col("_bw").isNull())
        x = x.withColumn("_w", F.coalesce(F.least(F.greatest(F.rint(F.col("_bw") / step / 8).cast("long"), F.lit(3)), top), F.col("_w")))
    return x.withColumn(out, F.col("_bw")).drop("_w", "_bw", "_dead", "_sm")


def occupied_99(psd: DataFrame, keys: list[str], step: float, share: float = 0.99) -> DataFrame:
    """Shortest contiguous band with 99% of the power.

    Wanted cumulative levels are merged into the cumulative curve by one sort, instead of pairing all bins.
    """
    part = W.partitionBy(*keys)
    c = psd.withColumn("_c", F.sum("power").over(part.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)))
    c = c.withColumn("_t", F.max("_c").over(part)).withColumn("_b0", F.min("bin").over(part))
    # start s wants cumulative(s) + share * total, where cumulative(s) excludes bin s
    ends = c.select(*keys, F.col("_c").alias("_v"), F.lit(1).alias("_k"), (F.col("bin") + 1).alias("_stop"), F.lit(None).cast("long").alias("_s"))
    starts = c.select(*keys, (F.coalesce(F.lag("_c").over(part.orderBy("bin")), F.lit(0.0)) + share * F.col("_t")).alias("_v"),
                      F.lit(0).alias("_k"), F.lit(None).cast("long").alias("_stop"), F.col("bin").cast("long").alias("_s"))
    e = ends.unionByName(starts)
    w = part.orderBy("_v", "_k", "_stop").rowsBetween(0, W.unboundedFollowing)
    e = e.withColumn("_hit", F.first("_stop", ignorenulls=True).over(w))
    n = psd.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    b = e.where("_k = 0").groupBy(*keys).agg(F.min(F.col("_hit") - F.col("_s")).alias("_m"))
    return b.join(n, keys).select(*keys, (F.least(F.coalesce("_m", "_n"), F.col("_n")) * step).alias("bandwidth_99pct_hz"))


def estimate_status(short: Column, resolved: Column, bw3: Column) -> Column:
    return (F.when(short, "not reliably estimated (insufficient occupied samples)")
             .when(~resolved, "not reliably estimated (no resolved excess power)")
             .when(bw3.isNull(), "partial (half-power lobe truncated by candidate band)").otherwise("estimated"))


def bandwidth_caveat(bw3: Column, bw99: Column) -> Column:
    return F.when(bw99 > 5 * bw3, F.lit(CAVEAT))


def parabolic_peak(p: Column, first: Column, step: float) -> Column:
    """Log-power three-bin vertex at the highest bin; NULL at the edges or when not concave. In Hz from `first`."""
    k = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    a, b, c = (F.log(F.greatest(F.get(p, k + j), F.lit(EPS))) for j in (-1, 0, 1))
    curve = a - 2 * b + c
    delta = F.least(F.greatest(0.5 * (a - c) / curve, F.lit(-0.5)), F.lit(0.5))
    ok = (k > 0) & (k < F.size(p) - 1) & (F.array_max(p) > 0)
    return F.when(ok, F.when(curve < 0, first + (k + delta) * step))


def lowest_near_peak(psd: DataFrame, keys: list[str], freq: Column, skip: int = 4) -> DataFrame:
    """Smallest frequency within 3 dB of the strongest bin, the first `skip` bins left out."""
    x = psd.where(F.col("bin") >= skip)
    top = F.max("power").over(W.partitionBy(*keys))
    x = x.withColumn("_top", top)
    return x.groupBy(*keys).agg(F.min(F.when((F.col("power") >= F.col("_top") / 10 ** 0.3) & (F.col("_top") > 0), freq))
                                .alias("symbol_rate_hz"))


def top_lines(psd: DataFrame, keys: list[str], freq, k: int, step: float) -> DataFrame:
    """k strongest local maxima, parabolic-refined."""
    w = W.partitionBy(*keys).orderBy("bin")
    x = psd.withColumn("_l", F.lag("power").over(w)).withColumn("_r", F.lead("power").over(w))
    x = x.where((F.col("power") > F.col("_l")) & (F.col("power") > F.col("_r")))
    a, b, c = (F.log(F.greatest(F.col(v), F.lit(EPS))) for v in ("_l", "power", "_r"))
    delta = F.least(F.greatest(0.5 * (a - c) / (a - 2 * b + c), F.lit(-0.5)), F.lit(0.5))
    rank = W.partitionBy(*keys).orderBy(F.desc("power"), "bin")
    return (x.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
             .select(*keys, "rank", (freq(F.col("bin")) + delta * step).alias("frequency_hz"), "power"))


def dedupe_tolerance(values: Column, lo: float, hi: float, tol: float) -> Column:
    """Keep array values in order, dropping any within a relative tolerance of a kept one."""
    start = F.array().cast("array<double>")
    return F.aggregate(values, start, lambda kept, v: F.when(
        (v >= lo) & (v <= hi) & ~F.exists(kept, lambda q: F.abs(v - q) / q < tol), F.array_append(kept, v)).otherwise(kept))


def inband_share(psd: DataFrame, keys: list[str], freq: Column, width: Column | float) -> DataFrame:
    inside = F.sum(F.when(F.abs(freq) <= width / 2, F.col("power")).otherwise(0.0))
    return psd.groupBy(*keys).agg((inside / F.greatest(F.sum("power"), F.lit(1e-300))).alias("inband_share"))


def occupied_centroid(psd: DataFrame, keys: list[str], freq: Column, rate: float) -> DataFrame:
    """Centroid of bins 3 dB over the 20th percentile, and that percentile as noise power."""
    f = psd.groupBy(*keys).agg(F.percentile("power", 0.2).alias("_f"))
    j = psd.join(f, keys)
    e = F.when(F.col("power") > 2 * F.col("_f"), F.col("power") - F.col("_f")).otherwise(0.0)
    return j.groupBy(*keys).agg(
        F.coalesce(F.sum(freq * e) / F.nullif(F.sum(e), F.lit(0.0)), F.lit(0.0)).alias("centroid_hz"),
        (F.max("_f") * rate).alias("noise_power"))


def model_snr(residual: Column, decim: Column, total: Column) -> Column:
    noise, signal = residual * decim, total - residual
    return F.when((noise > 0) & (signal > 0), 10.0 * F.log10(signal / noise))


def larger_snr(snr: Column, model: Column) -> tuple[Column, Column]:
    """Both estimates are biased low: keep the larger and say which."""
    use = model.isNotNull() & (snr.isNull() | (model > snr))
    return F.when(use, model).otherwise(snr), F.when(use, F.lit("model residual (published verify rebuild)")).when(
        snr.isNotNull(), F.lit("spectral (occupied power vs percentile noise floor)"))


def choose_decimation(n: Column, width: Column, rate: Column) -> tuple[Column, Column]:
    """(decimation, status): clamp(floor(rate / (4 width)), 1, n / 2000); a reason when too short."""
    wide = F.greatest(width, rate / 1024)
    d = F.greatest(F.lit(1), F.floor(rate / (OVERSAMPLE * wide)))
    d = F.greatest(F.lit(1), F.least(d, F.floor(n / MIN_SAMPLES))).cast("long")
    short = F.floor(n / d) < MIN_SAMPLES
    why = F.concat(F.lit("insufficient occupied samples ("), n.cast("string"), F.lit(" < 2000)"))
    return d, F.when(short, why)


def m2m4_snr(samples: DataFrame, keys: list[str]) -> DataFrame:
    p = F.col("i") * F.col("i") + F.col("q") * F.col("q")
    a = samples.groupBy(*keys).agg(F.avg(p).alias("_m2"), F.avg(p * p).alias("_m4"))
    s = F.sqrt(F.greatest(2 * F.col("_m2") * F.col("_m2") - F.col("_m4"), F.lit(1e-12)))
    n = F.greatest(F.col("_m2") - s, F.lit(1e-12))
    return a.select(*keys, F.least(F.greatest(10.0 * F.log10(s / n), F.lit(-10.0)), F.lit(30.0)).alias("snr_db"))


def consensus_rate(votes: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """The vote with most others within tol (lowest wins ties), the median of its supporters and their share.

    A range frame over log votes counts neighbours: |v - v0| / v0 < tol is a fixed log interval.
    """
    import math
    x = votes.where(F.col(value) > 0).withColumn("_l", F.log(value))
    down, up = -math.log(1 - tol), math.log(1 + tol)
    x = x.withColumn("_sup", F.expr(f"count(1) OVER (PARTITION BY {', '.join(keys)} ORDER BY _l "
                                    f"RANGE BETWEEN {down!r}D PRECEDING AND {up!r}D FOLLOWING)"))
    best = x.groupBy(*keys).agg(F.max(F.struct("_sup", (-F.col(value)).alias("_m"))).alias("_b"), F.count(F.lit(1)).alias("n_votes"))
    best = best.select(*keys, "n_votes", F.col("_b._sup").alias("support"), (-F.col("_b._m")).alias("best"))
    near = x.join(best, keys).where(F.abs(F.col(value) - F.col("best")) / F.col("best") < tol)
    return near.groupBy(*keys, "n_votes", "support", "best").agg(F.percentile(value, 0.5).alias("rate_hz")) \
        .withColumn("share", F.col("support") / F.col("n_votes")).drop("n_votes")
