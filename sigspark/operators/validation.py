"""Sample checks, limits, coverage and typed empty records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values
MAX_MAGNITUDE = 1e12
MIN_SAMPLES = 1024
MAX_CANDIDATES = 4096
MAX_PULSE_WINDOWS = 200_000
MAX_READ_SECONDS = 60.0
MAX_READ_SAMPLES = 2_000_000
FAILED_STATUS = "not reliably estimated (the bounded re-read failed)"
# downstream fields by type; the `*_status` ones carry the reason when nothing was measured
DOWNSTREAM = {
    "double": ["center_frequency_hz", "bandwidth_3db_hz", "bandwidth_99pct_hz", "snr_db", "envelope_variation",
               "modulation_confidence", "center_frequency_refined_hz", "refinement_sharpness", "symbol_rate_hz",
               "m_fam", "m_rate", "unexplained", "verify_model_snr_db", "verify_carrier_hz",
               "verify_inband_share"],
    "int": ["refinement_order"],
    "boolean": ["label_needs_review"],
    "string": ["bandwidth_99pct_caveat", "snr_method", "modulation_family", "modulation_label", "verify_family",
               "estimate_tier", "label_provenance"],
    "status": ["estimate_status", "modulation_status", "refinement_status", "symbol_rate_status",
               "verify_status", "fine_modulation_status"],
}


def capture_health(samples: DataFrame, keys: list[str]) -> DataFrame:
    """One row per capture with the first failed check as `reason` (NULL when it passes)."""
    mag = F.hypot("i", "q")
    bad = F.isnan(mag) | F.isnull(mag) | (mag == F.lit(float("inf")))
    a = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"),
                                   F.bool_or(bad).alias("not_finite"),
                                   F.max(F.when(~bad, mag)).alias("peak"))
    return a.withColumn("reason", health_reason())


def health_reason() -> Column:
    """First failed check of a row with not_finite, peak and n_samples."""
    return (F.when(F.col("not_finite"), "contains NaN or infinite samples")
             .when(F.col("peak") > MAX_MAGNITUDE, "sample magnitude is too large")
             .when(F.col("n_samples") < MIN_SAMPLES, "fewer than 1,024 samples"))


def validate_samples(samples: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of healthy captures, quarantine table with reasons)."""
    bad = capture_health(samples, keys).where(F.col("reason").isNotNull())
    return samples.join(bad.select(*keys), keys, "left_anti"), bad


def check_limits(tracks: DataFrame, windows: DataFrame, keys: list[str], max_tracks: int = MAX_CANDIDATES,
                 max_windows: int = MAX_PULSE_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """(tracks of captures within the limits, error rows of the others with their counts). Nothing is truncated, and one
    large capture does not stop the others."""
    nt = tracks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tracks"))
    nw = windows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"))
    n = nt.join(nw, keys, "left").withColumn("n_windows", F.coalesce("n_windows", F.lit(0).cast("long")))
    text = f"exceeds {max_tracks:,} candidates or {max_windows:,} pulse windows; results are not truncated"
    over = n.where((F.col("n_tracks") > max_tracks) | (F.col("n_windows") > max_windows)).withColumn("error", F.lit(text))
    return tracks.join(over.select(*keys), keys, "left_anti"), over


def check_coverage(blocks: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    done = blocks.groupBy(*keys).agg(F.sum(F.col("core_end") - F.col("core_start")).alias("processed"))
    out = catalog.join(done, keys, "left").withColumn("processed", F.coalesce("processed", F.lit(0)))
    return out.withColumn("complete", F.col("processed") == F.col("n_samples"))


def null_downstream(df: DataFrame, status: Column | str) -> DataFrame:
    """Add every downstream field as a typed NULL; status fields carry the reason."""
    reason = F.lit(status) if isinstance(status, str) else status
    cols = {c: F.lit(None).cast(t) for t, cs in DOWNSTREAM.items() if t != "status" for c in cs}
    cols |= {c: reason for c in DOWNSTREAM["status"]}
    return df.withColumns({c: e for c, e in cols.items() if c not in df.columns})


def rf_budget(rate: Column) -> Column:
    """Samples one bounded read may hold."""
    return F.least(F.floor(rate * MAX_READ_SECONDS), F.lit(MAX_READ_SAMPLES)).cast("long")
