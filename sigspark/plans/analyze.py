"""From sample blocks to measured tracks: checks, detection, limits, tracks and whole-track measurement in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators import blockbands as B, pulses as P, tracks as TR, validation as VA, wholetrack as WT
from ..session import written

KEYS = ["capture_id"]
NO_WINDOWS = "array<struct<start_sample:bigint,end_sample:bigint>>"


@dataclass
class Analysis:
    """`detections` of blocks, `tracks` with their measurements, and `errors`: captures without a result and why."""
    detections: DataFrame
    tracks: DataFrame
    errors: DataFrame


def block_health(blocks: DataFrame) -> DataFrame:
    """`validation.capture_health` from blocks: one row of bounds per block, added up per capture."""
    mag = F.zip_with("i", "q", lambda a, b: F.hypot(a, b))
    bad = F.exists(mag, lambda m: m.isNull() | F.isnan(m) | (m == float("inf")))
    fine = F.filter(mag, lambda m: m.isNotNull() & ~F.isnan(m) & (m < float("inf")))
    a = blocks.select(*KEYS, (F.col("core_end") - F.col("core_start")).alias("n"), bad.alias("bad"), F.array_max(fine).alias("peak"))
    a = a.groupBy(*KEYS).agg(F.sum("n").alias("n_samples"), F.bool_or("bad").alias("not_finite"), F.max("peak").alias("peak"))
    return a.withColumn("reason", VA.health_reason())


def detections_of(blocks: DataFrame, rate: float, nperseg: int, hop: int, block: int, margin_db: float, real: bool = False) -> DataFrame:
    """Detections cut to the core of their block, so that what two blocks see of one signal counts once."""
    d = B.detect(blocks, rate, nperseg, hop, margin_db, real=real).where("status = 'ok'")
    d = d.withColumns({"core_start": F.col("block_id") * block, "core_end": (F.col("block_id") + 1) * block, "pulse_windows": F.array().cast(NO_WINDOWS)})
    return P.clamp_to_core(d).drop("core_start", "core_end", "pulse_windows", "status")


def analyze(blocks: DataFrame, rate: float, nperseg: int = 1024, hop: int = 256, block: int = 524_288, margin_db: float = 8.0, real: bool = False,
            tuning_hz: float = 0.0, group_hz: float = TR.GROUP_HZ) -> Analysis:
    """Analyse captures given as sample blocks with guards (a reader's, or `blocks_from_chunks`).

    Captures that fail the sample checks, or hold more tracks than the limit, are in `errors` and nowhere else; the others go
    on. Detections are written once; samples are read for the checks, the spectra and the measurement of tracks, and never
    shuffled by any of them.
    """
    bad = written(block_health(blocks).where(F.col("reason").isNotNull()))
    good = blocks.join(bad.select(*KEYS), KEYS, "left_anti")
    det = written(detections_of(good, rate, nperseg, hop, block, margin_db, real))
    x = det.select("capture_id", F.col("block_id").alias("block"), F.col("fa").alias("det"), F.col("freq_lower_hz").alias("lo"), F.col("freq_upper_hz").alias("hi"),
                   F.col("threshold_excess_db").alias("excess"), "start_sample", "end_sample", F.col("confidence").alias("conf"), "needs_review",
                   F.lit(None).cast("boolean").alias("is_pulsed"), F.col("bounds_method").alias("method"), F.col("freq_extent_lower_hz").alias("extent_lo"),
                   F.col("freq_extent_upper_hz").alias("extent_hi"), F.col("confidence_evidence_based").alias("conf_evidence"))
    folded = TR.fold_tracks(TR.associate_tracks(x, group_hz))
    ok, over = VA.check_limits(folded, folded.select(*KEYS).limit(0), KEYS)
    tracks = written(ok)
    m = WT.measure_tracks(WT.track_partials(good, tracks, rate, nperseg, hop, block, real), tracks, rate, nperseg, tuning_hz)
    out = tracks.join(m, WT.KEYS, "left").withColumnsRenamed({"track": "id", "lo": "freq_lower_hz", "hi": "freq_upper_hz", "extent_lo": "freq_extent_lower_hz",
                                                              "extent_hi": "freq_extent_upper_hz", "conf_evidence": "confidence_evidence_based"})
    errors = bad.select(*KEYS, F.col("reason").alias("error")).union(over.select(*KEYS, "error"))
    return Analysis(det, out, errors)
