"""Quality flags of whole captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import db

# fixed values
DC_BINS, DC_RATIO_DB = 3, 15.0
FLAT_SPREAD_DB = 12.0
CLIP_LEVEL, CLIP_SHARE = 0.98, 0.001
FULL_SCALE = {"ci16_le": 1.0, "ci16_be": 1.0}


def dc_spike(psd: DataFrame, keys: list[str], freq: Column) -> DataFrame:
    """Strongest of the 3 bins nearest 0 Hz more than 15 dB over the median of the rest."""
    w = W.partitionBy(*keys).orderBy(F.abs(freq), "bin")
    x = psd.withColumn("_near", F.row_number().over(w) <= DC_BINS).withColumn("_db", db(F.col("power")))
    a = x.groupBy(*keys).agg(F.max(F.when(F.col("_near"), F.col("_db"))).alias("_top"),
                             F.percentile(F.when(~F.col("_near"), F.col("_db")), 0.5).alias("_rest"))
    return a.select(*keys, (F.col("_top") - F.col("_rest")).alias("dc_excess_db"),
                    F.coalesce(F.col("_top") - F.col("_rest") > DC_RATIO_DB, F.lit(False)).alias("dc_spike"))


def floor_nonflat(psd: DataFrame, keys: list[str]) -> DataFrame:
    a = psd.groupBy(*keys).agg(F.percentile(db(F.col("power")), F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    spread = F.col("_q")[1] - F.col("_q")[0]
    return a.select(*keys, spread.alias("spread_db"), (spread > FLAT_SPREAD_DB).alias("floor_nonflat"))


def clipping(samples: DataFrame, keys: list[str], datatype: str) -> DataFrame:
    """Share of samples near full scale: 1.0 for integer types, the capture's own peak otherwise."""
    full = F.coalesce(*[F.when(F.col(datatype) == k, F.lit(v)) for k, v in FULL_SCALE.items()])
    mag = F.hypot("i", "q")
    peak = samples.groupBy(*keys).agg(F.max(mag).alias("_peak"))
    scale = F.coalesce(full, F.col("_peak"))
    j = samples.join(peak, keys)
    a = j.groupBy(*keys).agg(F.avg((mag > CLIP_LEVEL * scale).cast("double")).alias("share_near_full_scale"), F.max("_peak").alias("peak"))
    return a.withColumn("clipping", (F.col("share_near_full_scale") > CLIP_SHARE) & (F.col("peak") > 0))


def triage_report(psd: DataFrame, samples: DataFrame, keys: list[str], freq: Column, datatype: str,
                  errors: DataFrame | None = None) -> DataFrame:
    """One row per capture with all flags, or an error row."""
    r = (dc_spike(psd, keys, freq).join(floor_nonflat(psd, keys), keys).join(clipping(samples, keys, datatype), keys)
         .select(*keys, "dc_spike", "floor_nonflat", "clipping", F.lit(None).cast("string").alias("error")))
    return r if errors is None else r.unionByName(errors.select(*keys, "error"), allowMissingColumns=True)
