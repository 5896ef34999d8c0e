"""Detection outputs: JSON, JSON lines, summary and export tables, annotations and their checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import finite_or_null
from ..operators.validation import MAX_CANDIDATES
from .documents import write_documents

# fixed values
SUMMARY_FIELDS = ["needs_review", "file", "detection_id", "label", "tier", "symbol_rate_hz", "center_frequency_hz", "bandwidth_3db_hz",
                  "snr_db", "freq_lower_hz", "freq_upper_hz", "start_sample", "end_sample", "status", "error"]
TIMING_KEYS = ("elapsed_ms", "verify_elapsed_ms")
SORT_KEYS = {"freq": "freq_lower_hz", "time": "start_sample", "confidence": "confidence", "pulsed": "is_pulsed", "review": "needs_review"}


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL; timing columns go."""
    keep = [c for c in df.columns if c not in TIMING_KEYS]
    types = dict(df.dtypes)
    return df.select(*[finite_or_null(F.col(c)).alias(c) if types[c] in ("double", "float") else F.col(c) for c in keep])


def over_limit(det: DataFrame, key: str = "file") -> DataFrame:
    """Captures with more detections than one document may hold: an error row each, in place of their document's list."""
    n = det.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") > MAX_CANDIDATES).withColumn("error", F.lit(f"exceeds {MAX_CANDIDATES:,} candidates; results are not truncated"))


def _within(det: DataFrame, key: str) -> DataFrame:
    return det.join(over_limit(det, key).select(key), key, "left_anti")


def detection_documents(det: DataFrame, captures: DataFrame, key: str = "file") -> DataFrame:
    """One row per capture with the list of its at most 4,096 detections. A capture with more has NULL for the list, since
    a row holds it whole, and an error row in `over_limit`; `write_detections` and `jsonl_rows` have all of them."""
    d = json_safe(det)
    fields = [c for c in d.columns if c != key]
    g = _within(d, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("detections"))
    big = over_limit(d, key).select(key, F.lit(True).alias("_over"))
    x = json_safe(captures).join(g, key, "left").join(big, key, "left")
    return x.withColumn("detections", F.when(F.col("_over").isNull(), F.coalesce("detections", F.array()))).drop("_over")


def write_detections(det: DataFrame, captures: DataFrame, path: str, key: str = "file") -> None:
    """One document per capture with any number of detections, ordered by their fields."""
    write_documents(json_safe(det), json_safe(captures), path, "detections", key)


def jsonl_rows(det: DataFrame) -> DataFrame:
    """One JSON line per detection, by file and then the id as text."""
    d = json_safe(det)
    rest = sorted(c for c in d.columns if c != "file")
    return d.orderBy("file", F.col("id").cast("string")).select(F.to_json(F.struct("file", *rest)).alias("value"))


def write_jsonl(det: DataFrame, path: str) -> None:
    jsonl_rows(det).write.mode("overwrite").text(path)


def general(v: Column) -> Column:
    """Six significant digits, exponent form outside 1e-4..1e6, no trailing zeros; empty for NULL. Rounded from the exact
    value, a batch at a time: a format string per value took longer than all else."""
    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        return pa.array(["" if k is None else "%.6g" % (k or 0.0) for k in x.to_pylist()], pa.string())
    return text(v)


def summary_rows(det: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """15 text columns per detection plus one row per failed file; review rows first.

    Raw values are sorted and then turned into text, so the sort moves numbers and each text is made once.
    """
    review = F.coalesce("needs_review", F.lit(False)) | F.coalesce("label_needs_review", F.lit(True))
    raw = det.select(
        review.alias("_review"), "file", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("detection_id"),
        "modulation_label", "estimate_tier", "symbol_rate_hz", F.coalesce("center_frequency_refined_hz", "center_frequency_hz").alias("_cf"),
        "bandwidth_3db_hz", "snr_db", "freq_lower_hz", "freq_upper_hz", "start_sample", "end_sample", "verify_status", F.lit("").alias("error"))
    if errors is not None:
        e = errors.select("file", "error", F.lit(True).alias("_review"), F.lit("").alias("detection_id"))
        raw = raw.unionByName(e, allowMissingColumns=True)
    raw = raw.orderBy(F.desc("_review"), "file", "detection_id")
    txt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return raw.select(
        F.when(F.col("_review"), "true").otherwise("false").alias("needs_review"), "file", "detection_id",
        txt("modulation_label").alias("label"), txt("estimate_tier").alias("tier"), general(F.col("symbol_rate_hz")).alias("symbol_rate_hz"),
        general(F.col("_cf")).alias("center_frequency_hz"),
        *[general(F.col(c)).alias(c) for c in ("bandwidth_3db_hz", "snr_db", "freq_lower_hz", "freq_upper_hz")],
        txt("start_sample").alias("start_sample"), txt("end_sample").alias("end_sample"), txt("verify_status").alias("status"), "error")


def write_summary(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def annotation(det: DataFrame) -> Column:
    """Sample count is end minus start, edges are absolute, the comment carries four fields as JSON."""
    tune = F.coalesce("tuning_hz", F.lit(0.0))
    return F.struct(F.col("start_sample").alias("core:sample_start"), (F.col("end_sample") - F.col("start_sample")).alias("core:sample_count"),
                    (tune + F.col("freq_lower_hz")).alias("core:freq_lower_edge"), (tune + F.col("freq_upper_hz")).alias("core:freq_upper_edge"),
                    F.concat(F.lit("Candidate "), F.col("id").cast("string")).alias("core:label"),
                    F.to_json(F.struct("confidence", "detection_method", "is_pulsed", "needs_review")).alias("core:comment"))


def sigmf_annotations(det: DataFrame, key: str = "file") -> DataFrame:
    """One annotation array per file, by start sample. A file over the limit has NULL for the array and the reason in
    `error`; `write_annotations` has all of them."""
    d, big = _within(det, key), over_limit(det, key)
    lists = d.groupBy(key).agg(F.array_sort(F.collect_list(annotation(d))).alias("annotations"))
    return lists.unionByName(big.select(key, "error"), allowMissingColumns=True)


def write_annotations(det: DataFrame, path: str, key: str = "file") -> None:
    """One document per file with its annotations by start sample, any number of them."""
    a = det.select(key, annotation(det).alias("a")).select(key, "a.*")
    write_documents(a, None, path, "annotations", key)


def validate_annotations(df: DataFrame, key: str = "file") -> DataFrame:
    """Required keys, non-negative counts and ordered edges; per file OK or the number of bad annotations."""
    error = F.col("error") if "error" in df.columns else F.lit(None).cast("string")
    a = df.select(key, error.alias("error"), F.explode_outer("annotations").alias("a"))
    lo, hi = F.col("a.core:freq_lower_edge"), F.col("a.core:freq_upper_edge")
    ok = (F.col("a.core:sample_start") >= 0) & (F.col("a.core:sample_count") >= 0) & (lo.isNull() == hi.isNull()) & F.coalesce(lo <= hi, F.lit(True))
    bad = F.count_if(F.col("a").isNotNull() & ~F.coalesce(ok, F.lit(False)))
    g = a.groupBy(key).agg(F.count("a").alias("n_annotations"), bad.alias("n_bad"), F.max("error").alias("_error"))
    return g.withColumn("status", F.when(F.col("_error").isNotNull(), F.col("_error")).when(F.col("n_bad") == 0, "OK").otherwise("invalid")).drop("_error")


def detections_csv(det: DataFrame, rate: Column) -> DataFrame:
    fixed = lambda c, n: F.format_string(f"%.{n}f", c)
    s, e = F.col("start_sample") / rate, F.col("end_sample") / rate
    return det.select(
        "id", "start_sample", "end_sample", "freq_lower_hz", "freq_upper_hz", "confidence", "detection_method", "is_pulsed",
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("pulse_width_samples", "pri_samples")], "needs_review",
        fixed(s, 6).alias("start_time_s"), fixed(e, 6).alias("end_time_s"), fixed(e - s, 6).alias("duration_s"),
        fixed((F.col("freq_lower_hz") + F.col("freq_upper_hz")) / 2, 1).alias("center_freq_hz"),
        fixed(F.col("freq_upper_hz") - F.col("freq_lower_hz"), 1).alias("bandwidth_hz"))


def filter_confidence(det: DataFrame, least: float) -> DataFrame:
    return det.where(F.col("confidence") >= least)


def review_only(det: DataFrame) -> DataFrame:
    return det.where("needs_review")


def sort_detections(det: DataFrame, key: str, descending: bool = False, tie: tuple[str, ...] = ("id",)) -> DataFrame:
    c = F.col(SORT_KEYS[key])
    return det.orderBy(c.desc() if descending else c.asc(), *tie)
