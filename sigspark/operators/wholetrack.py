"""Measurements over every sample of a track, from partial sums per (track, block).

A block's task reads its samples once, whatever number of tracks run through it, and gives one row of sums per track: frames
and summed power per bin, samples and summed powers of the envelope, and summed phase steps. Sums of blocks add up, so a
track of any length is measured from all its samples; long ones are spread over all tasks that hold their blocks.
A frame belongs to the block that holds its centre, a sample to the block whose core holds it, so guards count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import bound_batches
from .spectra import BLOCK_COLUMNS, frame_power

KEYS = ["capture_id", "track"]
PARTIALS = ("capture_id long, track long, block_id long, n_frames long, n_samples long, m2 double, m4 double, peak double, n_steps long, "
            "step_re double, step_im double, power array<double>")


def with_spans(blocks: DataFrame, tracks: DataFrame, block: int) -> DataFrame:
    """Blocks with `spans`, the (track, start, end) of the tracks that touch their core; blocks without any go. A track is
    copied to the blocks it meets, as numbers only; samples are not shuffled again where blocks are keyed by (capture,
    block) already."""
    ids = F.sequence(F.floor(F.col("start_sample") / block), F.floor((F.col("end_sample") - 1) / block))
    t = tracks.where("end_sample > start_sample").select("capture_id", F.explode(ids).alias("block_id"), F.struct("track", "start_sample", "end_sample").alias("s"))
    t = t.groupBy("capture_id", "block_id").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    return blocks.join(t, ["capture_id", "block_id"])


def track_partials(blocks: DataFrame, tracks: DataFrame, rate: float, nperseg: int, hop: int, block: int, real: bool = False) -> DataFrame:
    """`PARTIALS` of every (track, block). tracks: capture_id, track, start_sample, end_sample; `block` is the core length."""
    bound_batches(blocks.sparkSession)
    kinds = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in PARTIALS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cid, bid, lft, c0, c1 = (batch.column(c)[row].as_py() for c in BLOCK_COLUMNS[:5])
                x = np.asarray(batch.column("i")[row].values, float) + 1j * np.asarray(batch.column("q")[row].values, float)
                power = frame_power(x, rate, nperseg, hop, real) if len(x) >= nperseg else np.zeros((0, nperseg))
                centre = (lft // hop + np.arange(len(power))) * hop + nperseg / 2
                p = np.abs(x) ** 2
                step = np.concatenate(([0j], x[1:] * np.conj(x[:-1])))  # from the sample before, in the guard if need be
                out = []
                for s in batch.column("spans")[row].as_py():
                    a, z = max(c0, s["start_sample"]), min(c1, s["end_sample"])
                    on = power[(centre >= a) & (centre < z)]
                    e = p[a - lft:z - lft]
                    b = max(a, s["start_sample"] + 1) if a > 0 else a + 1
                    d = step[b - lft:z - lft].sum()
                    out.append(dict(zip(schema.names, (cid, s["track"], bid, len(on), len(e), float(e.sum()), float((e * e).sum()), float(e.max(initial=0.0)),
                                                       max(0, z - b), float(d.real), float(d.imag), on.sum(axis=0) if len(on) else np.zeros(power.shape[1])))))
                yield pa.RecordBatch.from_pylist(out, schema)

    return with_spans(blocks, tracks, block).select(*BLOCK_COLUMNS, "spans").mapInArrow(run, PARTIALS)


def track_totals(partials: DataFrame) -> DataFrame:
    """One row per track: all frames, samples, powers and phase steps."""
    return partials.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_blocks"), *[F.sum(c).alias(c) for c in ("n_frames", "n_samples", "m2", "m4", "n_steps", "step_re", "step_im")], F.max("peak").alias("peak"))


def track_psd(partials: DataFrame) -> DataFrame:
    """Mean power of every (track, bin) over all frames of the track."""
    x = partials.select(*KEYS, "n_frames", F.posexplode("power").alias("bin", "p")).where("n_frames > 0")
    return x.groupBy(*KEYS, "bin").agg((F.sum("p") / F.sum("n_frames")).alias("power"), F.sum("n_frames").alias("n_frames"))


def measure_tracks(partials: DataFrame, tracks: DataFrame, rate: float, nperseg: int, tuning_hz: float = 0.0) -> DataFrame:
    """Level, signal-to-noise ratio from the second and fourth moment, mean frequency from phase steps, and centroid and
    share of power inside the track's band [lo, hi) in Hz. A track without a whole frame has NULL where frames are needed
    and says so in `status`."""
    t = track_totals(partials)
    m2, m4 = F.col("m2") / F.col("n_samples"), F.col("m4") / F.col("n_samples")
    s = F.sqrt(F.greatest(2 * m2 * m2 - m4, F.lit(1e-12)))
    snr = F.least(F.greatest(10.0 * F.log10(s / F.greatest(m2 - s, F.lit(1e-12))), F.lit(-10.0)), F.lit(30.0))
    mean_hz = F.when(F.col("n_steps") > 0, F.atan2("step_im", "step_re") * (rate / (2 * np.pi)) + tuning_hz)
    freq = (F.col("bin") - nperseg // 2) * (rate / nperseg)
    b = track_psd(partials).join(tracks.select(*KEYS, "lo", "hi"), KEYS).withColumns({"f": freq, "inside": (freq >= F.col("lo")) & (freq < F.col("hi"))})
    own = F.when(F.col("inside"), F.col("power"))
    f = b.groupBy(*KEYS).agg((F.sum(own * F.col("f")) / F.nullif(F.sum(own), F.lit(0.0)) + tuning_hz).alias("centroid_hz"),
                             (F.sum(own) / F.nullif(F.sum("power"), F.lit(0.0))).alias("inband_share"), F.max(own).alias("peak_density"))
    status = F.when(F.col("n_frames") == 0, "no whole frame").otherwise("measured")
    return t.join(f, KEYS, "left").select(
        *KEYS, "n_blocks", "n_frames", "n_samples", m2.alias("mean_power"), "peak", snr.alias("snr_db"), mean_hz.alias("mean_hz"), "centroid_hz", "inband_share",
        "peak_density", status.alias("status"))
