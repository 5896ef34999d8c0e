"""Isolated bands, envelopes, pulses, packets and bursts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import EPS, cmul, rotate
from ..session import written
from .partitioning import WHOLE, by_size, halo, halo_window, merge_intervals, quantiles, runs
from .spectra import _lists

# fixed values
FIR_TAPS = 257
HALF_SUPPORT = 128
CONTRAST = 8.0
MAX_DUTY = 0.75
MAX_BURSTS = 8


def mix_to_baseband(samples: DataFrame, center: Column | float, rate: float) -> DataFrame:
    """Multiply by exp(-2j*pi*center*n/rate) with the capture's own sample index."""
    c = F.lit(center) if not isinstance(center, Column) else center
    re, im = rotate(F.col("i"), F.col("q"), c * F.col("n") / rate)
    return samples.withColumns({"i": re, "q": im})


def fir_taps(left: float, right: float, n: int = FIR_TAPS) -> np.ndarray:
    """Hamming windowed-sinc pass band between two edges given as fractions of Nyquist, unit gain inside."""
    m = np.arange(n) - (n - 1) / 2
    h = (right * np.sinc(right * m) - left * np.sinc(left * m)) * np.hamming(n)
    ref = 0.0 if left == 0 else 1.0 if right == 1 else (left + right) / 2
    return h / np.sum(h * np.cos(np.pi * m * ref))


def isolate_band(blocks: DataFrame, rate: float, real: bool = False) -> DataFrame:
    """Filtered core samples of every block row with columns lower_hz and upper_hz.

    Complex input is mixed by the band centre and low-passed, real input band-passed. A guard of 128 samples
    makes the result independent of the block size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in
                   ("capture_id", "block_id", "lft", "core_start", "core_end", "lower_hz", "upper_hz")}
            for k in range(batch.num_rows):
                x = np.asarray(batch.column("i")[k].values, float) + 1j * np.asarray(batch.column("q")[k].values, float)
                lo, hi, lft = col["lower_hz"][k], col["upper_hz"][k], col["lft"][k]
                if real:
                    lo, hi = max(0.0, lo), min(rate / 2, hi)
                    y = x.real if lo <= 0 and hi >= rate / 2 else \
                        np.convolve(x.real, fir_taps(lo / (rate / 2), hi / (rate / 2)), "same")
                    y = y + 0j
                else:
                    n = np.arange(lft, lft + len(x))
                    cut = min(rate * 0.49, max((hi - lo) / 2, rate / 1024))
                    y = np.convolve(x * np.exp(-2j * np.pi * (lo + hi) / 2 * n / rate),
                                    fir_taps(0.0, cut / (rate / 2)), "same") \
                        if len(x) >= FIR_TAPS else _short(x, lo, hi, n, rate, cut)
                a, b = col["core_start"][k] - lft, col["core_end"][k] - lft
                yield pa.RecordBatch.from_arrays(
                    [pa.array([col["capture_id"][k]]), pa.array([col["block_id"][k]]), pa.array([lft + a]),
                     _lists(y.real[None, a:b].copy()), _lists(y.imag[None, a:b].copy())],
                    names=["capture_id", "block_id", "start", "i", "q"])

    def _short(x, lo, hi, n, rate, cut):
        full = np.convolve(x * np.exp(-2j * np.pi * (lo + hi) / 2 * n / rate), fir_taps(0.0, cut / (rate / 2)))
        return full[HALF_SUPPORT:HALF_SUPPORT + len(x)]

    return blocks.select("capture_id", "block_id", "lft", "core_start", "core_end", "lower_hz", "upper_hz", "i", "q") \
        .mapInArrow(run, "capture_id long, block_id long, start long, i array<double>, q array<double>")


def envelope_window(rate: float) -> int:
    return max(3, int(rate * 0.001))


def moving_mean(df: DataFrame, keys: list[str], pos: str, value: Column, w: int, total: str,
                block: int = 1 << 16, out: str = "envelope") -> DataFrame:
    """Centred mean of `w` samples; mirrored at both ends of the capture (`total` samples).

    Rows get a halo of w/2, so the window runs inside position blocks however long the capture is.
    """
    before, after = w // 2, w - 1 - w // 2
    p, n = F.col(pos), F.col(total)
    spots = F.filter(F.array(p, F.when(p < before, -p - 1), F.when(p >= n - after, 2 * n - 1 - p)),
                     lambda s: s.isNotNull())
    x = df.withColumn("_value", value).withColumn("_orig", p).withColumn(pos, F.explode(spots))
    # mirrored copies sit outside [0, n): shift keeps block numbers non-negative
    x = x.withColumn("_p", F.col(pos) + before)
    x = halo(x, keys, "_p", block, before, after)
    w_ = W.partitionBy(*keys, "_hb").orderBy("_p").rowsBetween(-before, after)
    return (x.withColumn(out, F.avg("_value").over(w_)).where(F.col("core") & (F.col(pos) == F.col("_orig")))
             .drop("_value", "_orig", "_p", "_hb", "core"))


def on_level(env: DataFrame, keys: list[str], value: str, w: int, noise: Column | float) -> DataFrame:
    """high = median of the w largest values, low = 10th percentile, and the on-level threshold."""
    noise = F.lit(noise) if not isinstance(noise, Column) else noise
    # the median of the w largest of n values is the value at rank n - 1 - (w - 1) / 2
    middle = lambda n: n - 1 - (F.least(F.lit(w), n) - 1) / 2
    j = quantiles(env, keys, value, {"high": middle, "low": 0.1}).withColumn("noise", noise)
    return j.withColumn("threshold", F.greatest(F.col("noise") * 4, F.col("low") + 0.45 * (F.col("high") - F.col("low"))))


def on_runs(env: DataFrame, level: DataFrame, keys: list[str], value: str, w: int, block: int = 1 << 16) -> DataFrame:
    """On runs with interior off gaps shorter than `w` filled."""
    on = env.join(level.select(*keys, "threshold"), keys).where(F.col(value) > F.col("threshold"))
    return runs(on, keys, "n", block, gap=w - 1)


def pulse_windows(env: DataFrame, level: DataFrame, keys: list[str], value: str, w: int,
                  block: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """(windows of pulsed captures, one summary row per capture)."""
    filled = on_runs(env, level, keys, value, w, block)
    total = env.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"))
    length = F.col("end") - F.col("start")
    s = filled.groupBy(*keys).agg(F.sum(length).alias("on_samples"), F.count_if(length >= 2 * w).alias("n_windows"))
    s = total.join(level, keys).join(s, keys, "left").na.fill(0, ["on_samples", "n_windows"])
    duty = F.col("on_samples") / F.col("n_samples")
    contrast = F.col("high") / F.greatest(F.col("low"), F.col("noise"), F.lit(EPS))
    s = s.withColumn("duty", duty).withColumn("contrast", contrast).withColumn(
        "is_pulsed", (F.col("n_windows") > 0) & (contrast > CONTRAST) & (duty > 0) & (duty < MAX_DUTY))
    win = (filled.where(length >= 2 * w).join(s.where("is_pulsed").select(*keys), keys)
                 .select(*keys, F.col("start").alias("start_sample"), F.col("end").alias("end_sample")))
    return win, s


def pulse_timing(windows: DataFrame, keys: list[str], block: int = 1 << 20, whole: int = WHOLE) -> DataFrame:
    """Median width and median start-to-start interval of any number of windows per key. A key of at most `whole` windows is
    looked at by one task, a larger one in position blocks (`_timing_in_blocks`); both are exact."""
    small, large = by_size(windows, keys, whole)
    step = F.col("start_sample") - F.lag("start_sample").over(W.partitionBy(*keys).orderBy("start_sample"))
    med = lambda c: F.rint(F.percentile(c, 0.5)).cast("long")
    out = small.withColumn("_step", step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"), med(F.col("end_sample") - F.col("start_sample")).alias("pulse_width_samples"), med("_step").alias("pri_samples"))
    return out if large is None else out.unionByName(_timing_in_blocks(large, keys, block))


def _timing_in_blocks(windows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Steps are taken inside position blocks and between the last and first starts of blocks next to each other; the medians
    of widths and steps are exact ranks of one table."""
    x = windows.withColumn("_bk", F.floor(F.col("start_sample") / block))
    step = F.col("start_sample") - F.lag("start_sample").over(W.partitionBy(*keys, "_bk").orderBy("start_sample"))
    edge = x.groupBy(*keys, "_bk").agg(F.min("start_sample").alias("_first"), F.max("start_sample").alias("_last"))
    over = edge.select(*keys, F.lit("step").alias("_what"), (F.col("_first") - F.lag("_last").over(W.partitionBy(*keys).orderBy("_bk"))).alias("_v"))
    both = F.explode(F.array(F.struct(F.lit("width").alias("_what"), (F.col("end_sample") - F.col("start_sample")).alias("_v")),
                             F.struct(F.lit("step").alias("_what"), F.col("_step").alias("_v"))))
    values = x.withColumn("_step", step).select(*keys, both.alias("_m")).select(*keys, "_m.*").unionByName(over)
    n = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"))
    q = quantiles(values, [*keys, "_what"], "_v", {"_med": 0.5})
    med = lambda what: F.rint(F.max(F.when(F.col("_what") == what, F.col("_med")))).cast("long")
    q = q.groupBy(*keys).agg(med("width").alias("pulse_width_samples"), med("step").alias("pri_samples"))
    return n.join(q, keys, "left").select(*keys, "n_windows", "pulse_width_samples", "pri_samples")


def clamp_to_core(det: DataFrame, core_start: str = "core_start", core_end: str = "core_end") -> DataFrame:
    """Cut detections and their windows to the core block; what becomes empty is dropped."""
    lo, hi = F.col(core_start), F.col(core_end)
    win = F.filter(F.transform("pulse_windows", lambda w: F.struct(
        F.greatest(w["start_sample"], lo).alias("start_sample"),
        F.least(w["end_sample"], hi).alias("end_sample"))), lambda w: w["end_sample"] > w["start_sample"])
    return det.withColumns({"start_sample": F.greatest("start_sample", lo), "end_sample": F.least("end_sample", hi),
                            "pulse_windows": win}).where(F.col("end_sample") > F.col("start_sample"))


def _above_peak(df: DataFrame, keys: list[str], value: str, frac: float) -> DataFrame:
    peak = df.groupBy(*keys).agg(F.max(value).alias("_peak"))
    return df.join(peak, keys).where(F.col(value) > F.col("_peak") * frac)


def strongest_packet(df: DataFrame, keys: list[str], value: str, gap: int, block: int = 1 << 16) -> DataFrame:
    """Longest group of samples above a quarter of the peak; pauses of more than `gap` samples split groups."""
    act = _above_peak(df, keys, value, 0.25)
    p = runs(act, keys, "n", block, gap=gap - 1)
    best = F.max_by(F.struct("start", "end", "n"), F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("b")
    return p.groupBy(*keys).agg(best, F.count(F.lit(1)).alias("n_packets")).select(
        *keys, "n_packets", F.col("b.start").alias("start_sample"), F.col("b.end").alias("end_sample"),
        F.col("b.n").alias("active_samples"))


def peak_region(df: DataFrame, keys: list[str], value: str, block: int = 1 << 16) -> DataFrame:
    """The run above a quarter of the peak that holds the (first) peak."""
    top = df.groupBy(*keys).agg(F.max_by("n", F.struct(F.col(value), -F.col("n"))).alias("peak_n"))
    r = runs(_above_peak(df, keys, value, 0.25), keys, "n", block)
    return (r.join(top, keys).where((F.col("peak_n") >= F.col("start")) & (F.col("peak_n") < F.col("end")))
             .select(*keys, "peak_n", F.col("start").alias("start_sample"), F.col("end").alias("end_sample")))


def instantaneous_frequency(samples: DataFrame, keys: list[str], rate: float, block: int = 1 << 16) -> DataFrame:
    """angle(x[n] * conj x[n-1]) * rate / 2pi; the previous sample comes through a halo of one row."""
    x = halo(samples, keys, "n", block, 1, 0)
    w = halo_window(keys, "n")
    pi, pq, pn = (F.lag(c).over(w) for c in ("i", "q", "n"))
    re, im = cmul(F.col("i"), F.col("q"), F.col("_pi"), -F.col("_pq"))
    x = x.withColumns({"_pi": pi, "_pq": pq, "_pn": pn})
    x = x.where(F.col("core") & (F.col("_pn") == F.col("n") - 1))
    return x.withColumn("fi", F.atan2(im, re) * (rate / (2 * np.pi))).drop("_pi", "_pq", "_pn", "_hb", "core")


def tone_split(fi: DataFrame, packets: DataFrame, keys: list[str], block: int = 1 << 16) -> DataFrame:
    """15th and 85th percentile of 3-sample smoothed frequency inside the packet, ends dropped."""
    inside = fi.join(packets.select(*keys, "start_sample", "end_sample"), keys) \
        .where((F.col("n") > F.col("start_sample")) & (F.col("n") < F.col("end_sample")))
    x = halo(inside, keys, "n", block, 1, 1)
    x = x.withColumn("_s", F.avg("fi").over(halo_window(keys, "n").rowsBetween(-1, 1))).where("core")
    x = x.where((F.col("n") >= F.col("start_sample") + 4) & (F.col("n") < F.col("end_sample") - 3))
    q = quantiles(x, keys, "_s", {"low_hz": 0.15, "high_hz": 0.85})
    return q.withColumn("centre_hz", (F.col("low_hz") + F.col("high_hz")) / 2) \
            .withColumn("split_hz", F.col("high_hz") - F.col("low_hz"))


def expected_band(kind: Column, centre: Column, split: Column, rate: Column) -> tuple[Column, Column]:
    """FSK: centre +- (split/2 + rate); ASK: spectral peak +- 2 * rate."""
    half = F.when(kind == "FSK2", split / 2 + rate).otherwise(2 * rate)
    return centre - half, centre + half


def state_runs(df: DataFrame, keys: list[str], pos: str, state: str) -> DataFrame:
    """Maximal runs of equal state inside bounded segments."""
    w = W.partitionBy(*keys).orderBy(pos)
    x = df.withColumn("_new", (~F.coalesce(F.lag(state).over(w) == F.col(state), F.lit(False))).cast("int"))
    x = x.withColumn("_g", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*keys, "_g", state).agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("_g")


def run_length_encode(rle: DataFrame, keys: list[str], state: str, min_run: int) -> DataFrame:
    """Absorb runs shorter than `min_run` into their predecessor; a short first run goes forwards.

    Long runs (and the first) are anchors; anchors of equal state join and each group reaches to the next.
    """
    w = W.partitionBy(*keys).orderBy("start")
    x = rle.withColumn("_first", F.row_number().over(w) == 1).withColumn("_stop", F.max("end").over(W.partitionBy(*keys)))
    x = x.where(F.col("_first") | (F.col("end") - F.col("start") >= min_run))
    x = x.withColumn("_new", F.col("_first") | (F.lag(state).over(w) != F.col(state))).where("_new")
    x = x.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("_stop")))
    # a first group that is still short joins the next one
    x = x.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).withColumn("_rn", F.row_number().over(w))
    short = (F.col("_rn") == 1) & (F.col("_n") > 1) & (F.col("end") - F.col("start") < min_run)
    x = x.withColumn("_drop", short).withColumn("_prev", F.lag(F.struct("_drop", "start")).over(w))
    x = x.withColumn("start", F.when(F.col("_prev._drop"), F.col("_prev.start")).otherwise(F.col("start")))
    return x.where(~F.col("_drop")).select(*keys, state, "start", "end")


def two_level_threshold(df: DataFrame, keys: list[str], value: str, start: DataFrame, rounds: int = 10) -> DataFrame:
    """1-D 2-means from the levels in `start` (keys, lo, hi); each round is one small aggregate.

    The levels of a round, a row per key, are written before the next one: in one plan a task would hold the sorts and
    aggregates of all rounds. `df` (written or cheap to read) is read once per round."""
    state = written(start.select(*keys, "lo", "hi"))
    for _ in range(rounds):
        thr = (F.col("lo") + F.col("hi")) / 2
        low = F.col(value) <= thr
        a = df.select(*keys, value).join(state, keys).groupBy(*keys, "lo", "hi").agg(
            F.avg(F.when(low, F.col(value))).alias("_l"), F.avg(F.when(~low, F.col(value))).alias("_h"))
        both = F.col("_l").isNotNull() & F.col("_h").isNotNull()
        state = written(a.select(*keys, F.when(both, F.col("_l")).otherwise(F.col("lo")).alias("lo"),
                                 F.when(both, F.col("_h")).otherwise(F.col("hi")).alias("hi")))
    return state.withColumn("threshold", (F.col("lo") + F.col("hi")) / 2)


def top_bursts(windows: DataFrame, keys: list[str], k: int = MAX_BURSTS) -> DataFrame:
    """The k longest windows; each map task keeps only its own k candidates per key."""
    w = W.partitionBy(*keys).orderBy(F.desc(F.col("end_sample") - F.col("start_sample")), "start_sample", "end_sample")
    return windows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def joined_bursts(windows: DataFrame, keys: list[str], cap: int, min_parts: int = 2) -> DataFrame:
    """Windows in time order until `cap` samples are reached, for captures with at least two."""
    w = W.partitionBy(*keys).orderBy("start_sample", "end_sample")
    length = F.col("end_sample") - F.col("start_sample")
    x = windows.withColumn("_before", F.coalesce(F.sum(length).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    x = x.where(F.col("_before") < cap)
    x = x.withColumn("_parts", F.count(F.lit(1)).over(W.partitionBy(*keys))).where(F.col("_parts") >= min_parts)
    return x.withColumn("offset", F.col("_before")).drop("_before", "_parts")


def longest_window(windows: DataFrame, keys: list[str]) -> DataFrame:
    return windows.groupBy(*keys).agg(F.max_by(F.struct("start_sample", "end_sample"), F.struct(
        F.col("end_sample") - F.col("start_sample"), -F.col("start_sample"))).alias("w")).select(
        *keys, "w.start_sample", "w.end_sample")


def corrected_segment(blocks: DataFrame, windows: DataFrame, rate: float, residual: Column,
                      min_len: int = 1024 + 2 * HALF_SUPPORT) -> DataFrame:
    """Longest window isolated to its band, residual offset removed, filter support cut off at both ends.

    `windows` carries lower_hz and upper_hz per capture. Samples outside the window are zeroed before the
    filter, block by block, as if the window were a capture of its own. A capture whose longest window is under `min_len`
    has one row of NULLs with the reason in `status`.
    """
    longest = longest_window(windows, ["capture_id"])
    enough = F.col("end_sample") - F.col("start_sample") >= min_len
    w = longest.where(enough)
    band = windows.select("capture_id", "lower_hz", "upper_hz").distinct()
    b = blocks.join(w.join(band, "capture_id"), "capture_id") \
        .where((F.col("core_end") > F.col("start_sample")) & (F.col("core_start") < F.col("end_sample")))
    for c in ("i", "q"):
        b = b.withColumn(c, F.transform(c, lambda v, k: F.when(
            (F.col("lft") + k >= F.col("start_sample")) & (F.col("lft") + k < F.col("end_sample")), v).otherwise(0.0)))
    iso = isolate_band(b, rate)
    z = iso.select("capture_id", "start", F.posexplode(F.arrays_zip("i", "q")).alias("p", "s")).select(
        "capture_id", (F.col("start") + F.col("p")).alias("n"), F.col("s.i").alias("i"), F.col("s.q").alias("q"))
    z = z.join(w.join(band, "capture_id"), "capture_id").withColumn("k", F.col("n") - F.col("start_sample"))
    z = z.where((F.col("k") >= HALF_SUPPORT) & (F.col("n") < F.col("end_sample") - HALF_SUPPORT))
    re, im = rotate(F.col("i"), F.col("q"), residual * F.col("k") / rate)
    z = z.withColumns({"i": re, "q": im, "status": F.lit("ok")}).select("capture_id", "n", "k", "i", "q", "status")
    short = longest.where(~enough).select("capture_id", F.lit(f"longest window under {min_len} samples").alias("status"))
    return z.unionByName(short, allowMissingColumns=True)
