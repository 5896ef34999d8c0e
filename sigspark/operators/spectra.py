"""Blocks with guard samples, frames, spectra, noise floors and pooled displays.

The block is the unit of work: a capture of any length becomes many (capture, block) rows, each bounded by
block + 2 * guard samples, so FFT work and everything keyed by (capture, block) stays small and parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import EPS, db
from ..session import bound_batches

BLOCK_SAMPLES = 524_288
GUARD_SAMPLES = 4_096
DISPLAY_ROWS = 768

BLOCK_KEYS = ["capture_id", "block_id"]


def guard_length(block: int, rate: float, hop: int = 256, minimum: int = GUARD_SAMPLES) -> int:
    g = min(block // 2, max(minimum, int(rate * 0.001)))
    return -(-g // hop) * hop


def blocks_from_chunks(chunks: DataFrame, block: int, guard: int) -> DataFrame:
    """chunks(capture_id, start, i[], q[]) -> one row per block with its guard samples.

    One shuffle, keyed by (capture, block): a chunk is copied only to the blocks it touches.
    """
    start, size = F.col("start"), F.size("i")
    first = F.greatest(F.floor((start - guard) / block), F.lit(0))
    last = F.floor((start + size + guard - 1) / block)
    spread = chunks.withColumn("block_id", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("block_id") * block - guard, F.lit(0))
    hi = (F.col("block_id") + 1) * block + guard
    cut = F.greatest(lo - start, F.lit(0))
    keep = F.least(start + size, hi) - start - cut
    spread = (spread.withColumn("_cut", cut.cast("int")).withColumn("_keep", keep.cast("int"))
                    .where(F.col("_keep") > 0)
                    .select("capture_id", "block_id", F.struct(
                        (start + F.col("_cut")).alias("start"),
                        F.slice("i", F.col("_cut") + 1, F.col("_keep")).alias("i"),
                        F.slice("q", F.col("_cut") + 1, F.col("_keep")).alias("q")).alias("c")))
    g = spread.groupBy("capture_id", "block_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    g = g.select("capture_id", "block_id", F.col("c")[0]["start"].alias("lft"),
                 F.flatten(F.transform("c", lambda x: x["i"])).alias("i"),
                 F.flatten(F.transform("c", lambda x: x["q"])).alias("q"))
    core = F.col("block_id") * block
    return (g.withColumn("core_start", core)
             .withColumn("core_end", F.least(core + block, F.col("lft") + F.size("i")))
             .where(F.col("core_end") > F.col("core_start")))


def samples_from_chunks(chunks: DataFrame) -> DataFrame:
    """Long layout (capture_id, n, i, q)."""
    z = chunks.select("capture_id", "start", F.posexplode(F.arrays_zip("i", "q")).alias("p", "s"))
    return z.select("capture_id", (F.col("start") + F.col("p")).alias("n"),
                    F.col("s.i").alias("i"), F.col("s.q").alias("q"))


def frames_of_samples(samples: DataFrame, nperseg: int, hop: int, total: Column | str,
                      rate: float) -> DataFrame:
    """Long layout of overlapping frames: each sample goes to the nperseg/hop frames that hold it."""
    n = F.col("n")
    first = F.greatest(F.ceil((n - nperseg + 1) / hop), F.lit(0))
    last = F.least(F.floor(n / hop), F.floor((F.col(total) if isinstance(total, str) else total) - nperseg) / hop)
    out = samples.withColumn("_last", F.floor(last)).withColumn("_first", first)
    out = out.where(F.col("_first") <= F.col("_last"))
    out = out.withColumn("frame", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
    return (out.withColumn("k", n - F.col("frame") * hop)
               .withColumn("t", (nperseg / 2 + F.col("frame") * hop) / F.lit(rate)))


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def frame_power(x: np.ndarray, rate: float, nperseg: int, hop: int, real: bool = False) -> np.ndarray:
    """[frames, bins] power density of a 1-D array; two-sided and shifted, or one-sided for real input."""
    w = hann(nperseg)
    seg = np.lib.stride_tricks.sliding_window_view(x, nperseg)[::hop] * w
    scale = 1.0 / (rate * float(np.sum(w * w)))
    if real:
        p = np.abs(np.fft.rfft(seg.real, axis=1)) ** 2 * scale
        p[:, 1:(nperseg + 1) // 2] *= 2.0
        return p
    return np.abs(np.fft.fftshift(np.fft.fft(seg, axis=1), axes=1)) ** 2 * scale


def _smooth3x3(p: np.ndarray) -> np.ndarray:
    e = np.pad(p, 1, mode="edge")
    rows = e[:-2] + e[1:-1] + e[2:]
    return (rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]) / 9.0


def _open2x2(m: np.ndarray) -> np.ndarray:
    sq = m[:-1, :-1] & m[1:, :-1] & m[:-1, 1:] & m[1:, 1:]
    out = np.zeros_like(m)
    for df in (0, 1):
        for dk in (0, 1):
            out[df:df + sq.shape[0], dk:dk + sq.shape[1]] |= sq
    return out


def short_blocks(blocks: DataFrame, nperseg: int) -> DataFrame:
    """Blocks that hold no whole frame, with the reason: the scan has no spectrum of them, they are not lost."""
    n = F.size("i")
    return blocks.where(n < nperseg).select(*BLOCK_KEYS, "core_start", "core_end", n.cast("long").alias("n_samples"),
                                            F.format_string(f"fewer than {nperseg} samples (%s)", n).alias("status"))


BLOCK_COLUMNS = ["capture_id", "block_id", "lft", "core_start", "core_end", "i", "q"]


@dataclass
class BlockSpectra:
    """Spectra of one block inside a task; `power` is None for a block under one frame."""
    capture_id: int
    block_id: int
    lft: int
    core_start: int
    core_end: int
    n_samples: int
    first_frame: int
    power: np.ndarray | None = None
    floor: float | None = None
    smooth: np.ndarray | None = None

    def above(self, margin_db: float, fixed_db: float | None = None) -> np.ndarray:
        line = 10 * np.log10(self.floor) + margin_db if fixed_db is None else fixed_db
        return 10 * np.log10(np.maximum(self.smooth, EPS)) > line


def check_margin(margin_db: float, fixed_db: float | None) -> None:
    if fixed_db is None and not 3 <= margin_db <= 30:
        raise ValueError("Adaptive margin must be between 3 and 30 dB.")


def block_spectra(batches: Iterator[pa.RecordBatch], rate: float, nperseg: int, hop: int, real: bool) -> Iterator[BlockSpectra]:
    """Every block of a task with its frame spectra, floor and smoothed spectra, one at a time."""
    every = nperseg // 2 // hop
    for batch in batches:
        meta = {c: batch.column(c).to_pylist() for c in BLOCK_COLUMNS[:5]}
        ii, qq = batch.column("i"), batch.column("q")
        for row in range(batch.num_rows):
            i, q = (np.asarray(c[row].values, float) for c in (ii, qq))
            b = BlockSpectra(**{c: v[row] for c, v in meta.items()}, n_samples=len(i), first_frame=meta["lft"][row] // hop)
            if len(i) >= nperseg:
                b.power = frame_power(i + 1j * q, rate, nperseg, hop, real)
                b.floor = max(float(np.median(b.power[::every].mean(axis=0))), EPS)
                b.smooth = _smooth3x3(b.power)
            yield b


SCAN_SCHEMA = ("capture_id long, block_id long, lft long, rgt long, core_start long, core_end long, frame long, "
               "is_core boolean, floor double, power array<double>, smooth array<double>, above array<boolean>, "
               "hit array<boolean>")


def _lists(a: np.ndarray) -> pa.ListArray:
    n, k = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(a.reshape(-1)))


def scan_blocks(blocks: DataFrame, rate: float, nperseg: int = 1024, hop: int | None = None,
                margin_db: float = 8.0, fixed_db: float | None = None, real: bool = False) -> DataFrame:
    """One pass per block: frame spectra, block noise floor, 3x3 smoothing, threshold and 2x2 opening.

    One row per frame with bin arrays. Blocks are independent Arrow rows, so the work spreads over all tasks.
    `floor` is the frequency median of the block's 50%-overlap average spectrum. Blocks under one frame have no row here;
    `short_blocks` lists them.
    """
    check_margin(margin_db, fixed_db)
    bound_batches(blocks.sparkSession)
    hop = hop or nperseg // 4

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in block_spectra(batches, rate, nperseg, hop, real):
            if b.power is None:
                continue
            above = b.above(margin_db, fixed_db)
            n = len(b.power)
            frame = b.first_frame + np.arange(n)
            centre = frame * hop + nperseg / 2

            def full(v):
                return pa.array(np.full(n, v, np.int64))
            yield pa.RecordBatch.from_arrays(
                [full(b.capture_id), full(b.block_id), full(b.lft), full(b.lft + b.n_samples),
                 full(b.core_start), full(b.core_end), pa.array(frame), pa.array((centre >= b.core_start) & (centre < b.core_end)),
                 pa.array(np.full(n, b.floor)), _lists(b.power), _lists(b.smooth), _lists(above),
                 _lists(_open2x2(above))],
                names=[c.split()[0] for c in SCAN_SCHEMA.split(", ")])

    return blocks.select(*BLOCK_COLUMNS).mapInArrow(scan, SCAN_SCHEMA)


def cells(frames: DataFrame, *arrays: str) -> DataFrame:
    """Explode frame rows to one row per (frame, bin)."""
    arrays = arrays or ("power",)
    keep = [c for c in frames.columns if c not in ("power", "smooth", "above", "hit")]
    z = F.posexplode(F.arrays_zip(*arrays)).alias("bin", "c")
    return frames.select(*keep, z).select(*keep, "bin", *[F.col(f"c.{a}").alias(a) for a in arrays])


def bin_frequency(nbins: int, rate: float, b: Column | None = None) -> Column:
    return ((b if b is not None else F.col("bin")) - nbins // 2) * (rate / nbins)


def welch_psd(cell: DataFrame, keys: list[str], hop_ratio: int, origin: Column) -> DataFrame:
    """Mean over the 50%-overlap subset of frames; `hop_ratio` frames per half segment."""
    return (cell.where((F.col("frame") - origin) % hop_ratio == 0)
                .groupBy(*keys, "bin").agg(F.avg("power").alias("power")))


def noise_floor_median(psd: DataFrame, keys: list[str]) -> DataFrame:
    """Frequency median; the group size is the number of bins."""
    return psd.groupBy(*keys).agg(F.greatest(F.percentile("power", 0.5), F.lit(EPS)).alias("noise_floor"))


def gamma_quantile_table(segment_counts: list[int], prob: float = 0.2) -> dict[int, float]:
    """20% quantile over mean of a gamma distribution with shape K/1.056, by bisection on the series CDF."""
    import math

    def cdf(a: float, x: float) -> float:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    out = {}
    for kk in segment_counts:
        a = kk / 1.056
        lo, hi = 1e-12, a
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if cdf(a, mid) < prob else (lo, mid)
        out[kk] = lo / a
    return out


def gamma_ratio(segments: Column) -> Column:
    """The quantile's share of the mean for any number of averaged segments; each number is solved once per task.

    The function is made here: functions that are sent to tasks carry their modules, and a module that holds a used
    function of Spark's cannot be sent.
    """
    known: dict[int, float] = {}

    @F.pandas_udf("double")
    def ratio(k: pd.Series) -> pd.Series:
        known.update(gamma_quantile_table(sorted({int(x) for x in k.dropna().unique()} - known.keys())))
        return k.map(known)
    return ratio(segments)


def noise_floor_robust(psd: DataFrame, keys: list[str], q: Column) -> DataFrame:
    """20th percentile of the usable bins over its expected ratio `q`, bounded under the median; NULL where q is."""
    med = psd.groupBy(*keys).agg(F.greatest(F.percentile("power", 0.5), F.lit(EPS)).alias("med"))
    j = psd.join(med, keys)
    usable = F.col("power") >= F.col("med") / 10
    a = j.groupBy(*keys, "med").agg(
        F.count_if(usable).alias("usable_bins"),
        F.percentile(F.when(usable, F.col("power")), 0.2).alias("p20_usable"),
        F.percentile("power", 0.2).alias("p20_all"))
    p20 = F.when(F.col("usable_bins") >= 16, F.col("p20_usable")).otherwise(F.col("p20_all"))
    floor = F.greatest(p20 / F.col("_q"), F.col("med") / 10 ** 0.6, F.lit(EPS))
    return a.withColumn("_q", q).select(*keys, "usable_bins", F.when(F.col("_q").isNotNull(), floor).alias("noise_floor"))


def block_weighted_psd(psd: DataFrame, weight: Column) -> DataFrame:
    return psd.groupBy("capture_id", "bin").agg((F.sum(F.col("power") * weight) / F.sum(weight)).alias("power"))


def floor_summary(floors: DataFrame, margin_db: float) -> DataFrame:
    """Median and range of block floors in dB; one value per block goes in, any number of blocks per capture."""
    from .partitioning import quantiles
    x = floors.withColumn("_db", db(F.col("noise_floor")))
    a = x.groupBy("capture_id").agg(F.min("_db").alias("floor_min_db"), F.max("_db").alias("floor_max_db"))
    a = quantiles(x, ["capture_id"], "_db", {"noise_floor_db": 0.5}).join(a, "capture_id")
    return a.withColumn("threshold_db", F.col("noise_floor_db") + margin_db)


def adaptive_length(shortest: Column, lo: int = 64, hi: int = 1024) -> Column:
    """2^floor(log2(shortest/16)) within [lo, hi]."""
    base = F.greatest(F.floor(shortest / 16), F.lit(1))
    return F.least(F.greatest(F.pow(F.lit(2.0), F.floor(F.log2(base.cast("double")))), F.lit(float(lo))),
                   F.lit(float(hi))).cast("long")


def mean_subset_psd(window_psd: DataFrame, keys: list[str], min_len: int) -> DataFrame:
    """Equal-weight mean of per-window spectra; NULL when any window is shorter than one segment."""
    a = window_psd.groupBy(*keys, "bin").agg(F.avg("power").alias("mean_power"), F.min("len").alias("shortest"))
    return a.select(*keys, "bin", F.when(F.col("shortest") >= min_len, F.col("mean_power")).alias("power"))


def overview_maxpool(cell: DataFrame, t: Column, duration: Column, rows: Column) -> DataFrame:
    row = F.least(rows - 1, F.floor(t / duration * rows))
    return (cell.withColumn("row", row.cast("long"))
                .groupBy("capture_id", "row", "bin").agg(F.max("power").alias("power")))


def linspace_bucket(pos: Column, n: Column, buckets: int | Column) -> Column:
    """Bucket b holds [floor(b*n/buckets), floor((b+1)*n/buckets)): integer edges of an even split."""
    bk = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.ceil((pos + 1) * bk / n).cast("long") - 1


def viewport_maxpool(cell: DataFrame, frames: Column, bins: int, w: int, h: int) -> DataFrame:
    """Max pool on both axes; at most w*h rows per capture."""
    x = linspace_bucket(F.col("frame"), frames, F.least(F.lit(w), frames))
    y = linspace_bucket(F.col("bin"), F.lit(bins), min(h, bins))
    pooled = (cell.withColumn("x", x).withColumn("y", y)
                  .groupBy("capture_id", "x", "y").agg(F.max("power").alias("power")))
    lim = pooled.groupBy("capture_id").agg(F.percentile(db(F.col("power")), 0.05).alias("low_db"),
                                           F.max(db(F.col("power"))).alias("high_db"))
    return pooled.join(lim, "capture_id")


def waveform_maxpool(samples: DataFrame, total: Column, points: int) -> DataFrame:
    b = linspace_bucket(F.col("n"), total, F.least(F.lit(points), total))
    return (samples.withColumn("bucket", b).groupBy("capture_id", "bucket")
                   .agg(F.max(F.hypot("i", "q")).alias("value"), F.min("n").alias("first_n")))


def psd_thin(psd: DataFrame, nbins: Column, keep: int = 800) -> DataFrame:
    step = F.greatest(F.lit(1), F.floor(nbins / keep))
    return psd.where(F.col("bin") % step == 0)


def smooth3x3(cell: DataFrame, keys: list[str]) -> DataFrame:
    """Relational 3x3 mean with replicated edges, for cells that are already long (two window passes)."""
    for along, other in (("frame", "bin"), ("bin", "frame")):
        src = "power" if along == "frame" else "_s"
        w = W.partitionBy(*keys, other).orderBy(along)
        s = (F.coalesce(F.lag(src).over(w), F.col(src)) + F.col(src)
             + F.coalesce(F.lead(src).over(w), F.col(src))) / 3
        cell = cell.withColumn("_s", s)
    return cell.withColumnRenamed("_s", "smooth")
