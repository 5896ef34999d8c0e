"""Truth matching, score statistics, pass/fail criteria and report tables.

Ratios are NULL on an empty denominator. Medians over any number of rows use the bucketed exact quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.expr import ratio, share
from .partitioning import FINE, numbered, prefix_sums, quantiles, value_bucket

# fixed values: pass/fail thresholds
MIN_SNR_DB = 5.0
CF_FRAC = 0.10
BW3_TOL = 0.25
SNR_TOL_DB = 2.0
RATE_TOL = 0.05
RATIO_LO, RATIO_HI = 0.5, 2.0
SPEED_S = 0.5
# fixed values: id, statistic, test, limit, generators
CRITERIA = [
    ("D1", "recall", ">=", 0.95, ("G1", "G2")), ("D2", "noise_false", "<=", 0.05, ("G1", "G2")),
    ("D3", "fragmentation", "<=", 0.05, ("G1", "G2")), ("P1", "cf_ok", ">=", 0.90, ("G1", "G2")),
    ("P2", "bw3_ok", ">=", 0.90, ("G1", "G2")), ("P3", "snr_ok", ">=", 0.90, ("G1", "G2")),
    ("L1", "label_wrong", "<=", 0.03, ("G1", "G2")), ("L2", "label_correct", ">=", 0.60, ("G1", "G2")),
    ("R1", "rate_wrong", "<=", 0.03, ("G1", "G2")), ("R2", "rate_correct", ">=", 0.50, ("G1", "G2")),
    ("C1", "noise_labelled", "<=", 0.0, ("G1", "G2")), ("C2", "ool_wrong", "<=", 0.10, ("G1", "G2")),
    ("C3", "calibration_claims", "<=", 0.0, ("G1", "G2")), ("S1", "within", ">=", 0.95, ("G1", "G2")),
    ("W1", "label_wrong", "<=", 0.03, ("G4",)), ("W2", "label_correct", ">=", 0.60, ("G4",)),
    ("W3", "ool_wrong", "<=", 0.10, ("G4",)), ("W4", "rate_wrong", "<=", 0.03, ("G4",)),
]


def label_matches(pred: Column, truth: Column) -> Column:
    """Exact label, or an order-less family label against any order of that family. Never NULL."""
    family = pred.isin("QAM", "FSK", "ASK") & (F.rtrim(truth, F.lit("0123456789")) == pred)
    return F.coalesce((truth != "noise") & ((pred == truth) | family), F.lit(False))


def rate_matches(pred: Column, truth: Column) -> Column:
    return F.coalesce(F.abs(pred - truth) / truth < RATE_TOL, F.lit(False))


def harmonic_error(pred: Column, truth: Column) -> Column:
    hit = F.lit(False)
    for m in (2.0, 3.0, 1 / 2, 1 / 3):
        hit = hit | F.coalesce(F.abs(pred - m * truth) / (m * truth) < RATE_TOL, F.lit(False))
    return hit


def _c(name: str) -> Column:
    return F.col(name)


def flags(rows: DataFrame) -> DataFrame:
    """Per-row outcomes every statistic below is a share of."""
    return rows.withColumns({
        "label_ok": label_matches(_c("label"), _c("truth")),
        "label_bad": _c("label").isNotNull() & ~label_matches(_c("label"), _c("truth")),
        "rate_ok": rate_matches(_c("rate"), _c("rate_true")),
        "rate_bad": _c("rate").isNotNull() & ~rate_matches(_c("rate"), _c("rate_true")),
        "strong": F.coalesce(_c("snr_true") >= MIN_SNR_DB, F.lit(False)),
        "noise": _c("truth") == "noise"})


def _label_shares() -> list[Column]:
    lib = _c("in_library") & _c("strong")
    return [F.count(F.lit(1)).alias("n"), share(_c("label_bad")).alias("label_wrong"),
            F.count_if(lib).alias("n_in_library"), share(_c("label_ok"), lib).alias("label_correct"),
            share(_c("label").isNotNull()).alias("published")]


def _rate_shares() -> list[Column]:
    dig = _c("digital") & _c("strong")
    return [F.count(F.lit(1)).alias("n"), share(_c("rate_bad")).alias("rate_wrong"), F.count_if(dig).alias("n_digital"),
            share(_c("rate_ok"), dig).alias("rate_correct"),
            share(harmonic_error(_c("rate"), _c("rate_true")), dig).alias("harmonic_errors")]


def _confidence_shares() -> list[Column]:
    ool, fm = _c("out_of_library"), _c("truth") == "FM"
    return [F.count_if("noise").alias("n_noise"), share(_c("label").isNotNull(), _c("noise")).alias("noise_labelled"),
            F.count_if(ool).alias("n_ool"), share(_c("label_bad"), ool).alias("ool_wrong"),
            F.count_if(fm).alias("n_fm"), share(F.coalesce(_c("label") == "FM", F.lit(False)), fm).alias("fm_labelled"),
            F.count_if(_c("claim") & _c("label").isNotNull()).alias("calibration_claims")]


def _detect_shares() -> list[Column]:
    sig, found = ~_c("noise"), ~_c("noise") & (_c("n_det") >= 1)
    return [F.count_if(sig & _c("strong")).alias("n_strong"), share(_c("hit"), sig & _c("strong")).alias("recall"),
            F.count_if("noise").alias("n_noise"), share(_c("n_det") >= 1, _c("noise")).alias("noise_false"),
            F.count_if(found).alias("n_found"), share(_c("n_det") >= 2, found).alias("fragmentation")]


def _linear() -> Column:
    return _c("bw3_true").isNotNull() & (_c("bw3_true") != 0) & _c("strong")


def _signal() -> Column:
    return ~_c("noise") & _c("strong")


def _param_shares() -> list[Column]:
    lin, sig, no = _linear(), _signal(), F.lit(False)
    cf = F.coalesce(F.abs(_c("cf") - _c("fc")) <= CF_FRAC * _c("bw3_true"), no)
    bw = F.coalesce(F.abs(_c("bw3") / F.nullif(_c("bw3_true"), F.lit(0.0)) - 1) <= BW3_TOL, no)
    snr = F.coalesce(F.abs(_c("snr") - _c("snr_true")) <= SNR_TOL_DB, no)
    return [F.count_if(lin).alias("n_linear"), share(cf, lin).alias("cf_ok"), share(bw, lin).alias("bw3_ok"),
            F.count_if(sig).alias("n_signal"), share(snr, sig).alias("snr_ok")]


def label_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    return flags(rows).groupBy(*keys).agg(*_label_shares())


def rate_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    return flags(rows).groupBy(*keys).agg(*_rate_shares())


def confidence_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    return flags(rows).groupBy(*keys).agg(*_confidence_shares())


def detect_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    return flags(rows).groupBy(*keys).agg(*_detect_shares())


def param_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    x = flags(rows)
    a = x.groupBy(*keys).agg(*_param_shares())
    both = F.explode(F.array(
        F.struct(F.lit("ratio").alias("s"), F.when(_linear(), _c("bw3") / F.nullif(_c("bw3_true"), F.lit(0.0))).alias("v")),
        F.struct(F.lit("error").alias("s"), F.when(_signal(), _c("snr") - _c("snr_true")).alias("v"))))
    q = quantiles(x.select(*keys, both.alias("m")).select(*keys, "m.s", "m.v"), [*keys, "s"], "v", {"med": 0.5})
    q = q.groupBy(*keys).agg(F.max(F.when(_c("s") == "ratio", _c("med"))).alias("median_bw3_ratio"),
                             F.max(F.when(_c("s") == "error", _c("med"))).alias("median_snr_err_db"))
    return a.join(q, keys, "left")


def speed_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    a = rows.where(_c("time_s").isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share(_c("time_s") <= SPEED_S).alias("within"), F.max("time_s").alias("max_s"))
    return a.join(quantiles(rows, keys, "time_s", {"p50_s": 0.5, "p95_s": 0.95}), keys)


TRUTH = ["capture_id", "truth_id"]
#: width of the frequency bins of the truth join; a parameter, it changes no result. Several times the usual band: a band is
#: shuffled once for every bin it meets
BIN_HZ = 512.0


def _binned(df: DataFrame, lo: str, hi: str, bin_hz: float) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(_c(lo) / bin_hz), F.floor(_c(hi) / bin_hz))))


def _centres(truth: DataFrame, det: DataFrame, bin_hz: float, *more: str) -> DataFrame:
    """Detections and the truth centres in their frequency bins, on (capture, bin): no capture meets itself as a whole.

    Truths grow with the tables: here and below they are merged, not broadcast through the driver while they are few."""
    t = truth.select(*TRUTH, "centre", *more, F.floor(_c("centre") / bin_hz).alias("_bin"))
    return _binned(det, "lo", "hi", bin_hz).join(t.hint("merge"), ["capture_id", "_bin"]).drop("_bin")


def match_center_in_band(truth: DataFrame, det: DataFrame, bin_hz: float = BIN_HZ) -> DataFrame:
    """Truth rows (capture_id, truth_id; several per capture) flagged by whether a detection strictly contains their centre."""
    j = _centres(truth, det, bin_hz)
    hit = j.where((_c("lo") < _c("centre")) & (_c("centre") < _c("hi"))).select(*TRUTH).distinct()
    return truth.join(hit.withColumn("detected", F.lit(True)).hint("merge"), TRUTH, "left").withColumn("detected", F.coalesce("detected", F.lit(False)))


def flag_detections(truth: DataFrame, det: DataFrame, bin_hz: float = BIN_HZ) -> DataFrame:
    """Detections with the number of truth centres strictly inside them; a detection is known by capture, number and band."""
    key = ["capture_id", "det", "lo", "hi"]
    j = _centres(truth, det, bin_hz).where((_c("lo") < _c("centre")) & (_c("centre") < _c("hi")))
    n = j.groupBy(*key).agg(F.countDistinct("truth_id").alias("n_truth"))
    return det.join(n.hint("merge"), key, "left").withColumn("n_truth", F.coalesce("n_truth", F.lit(0).cast("long")))


def match_best_overlap(truth: DataFrame, det: DataFrame, bin_hz: float = BIN_HZ) -> DataFrame:
    """Per truth row: detections of its capture, how many overlap its band, and the best overlapping one.

    Truths and detections meet in shared frequency bins, a pair counts in the first bin it shares.
    """
    t = _binned(truth.select(*TRUTH, _c("lo").alias("t_lo"), _c("hi").alias("t_hi")), "t_lo", "t_hi", bin_hz)
    j = _binned(det, "lo", "hi", bin_hz).join(t.hint("merge"), ["capture_id", "_bin"])
    ov = F.least("hi", "t_hi") - F.greatest("lo", "t_lo")
    j = j.where((_c("_bin") == F.floor(F.greatest("lo", "t_lo") / bin_hz)) & (ov > 0))
    best = F.max(F.struct(ov.alias("o"), (-_c("det")).alias("d"), _c("lo"), _c("hi")))
    a = j.groupBy(*TRUTH).agg(F.count(F.lit(1)).alias("n_overlap"), best.alias("b"))
    a = a.select(*TRUTH, "n_overlap", (-_c("b.d")).alias("best_det"), _c("b.o").alias("overlap_hz"), _c("b.lo").alias("best_lo"), _c("b.hi").alias("best_hi"))
    n = det.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_det"))
    out = truth.join(n.hint("merge"), "capture_id", "left").join(a.hint("merge"), TRUTH, "left").na.fill(0, ["n_det", "n_overlap"])
    return out.withColumn("hit", _c("best_det").isNotNull())


def match_time_freq(truth: DataFrame, det: DataFrame, bin_hz: float = BIN_HZ) -> DataFrame:
    """Per truth row: the strongest detection that overlaps the burst in time and contains its centre frequency."""
    x = truth.withColumns({"t_start": _c("start"), "t_end": _c("end")})
    j = _centres(x, det, bin_hz, "t_start", "t_end").where((_c("lo") <= _c("centre")) & (_c("centre") <= _c("hi"))
                                                           & (_c("start") < _c("t_end")) & (_c("end") > _c("t_start")))
    b = j.groupBy(*TRUTH).agg(F.max(F.struct("excess", (-_c("det")).alias("d"), "lo", "hi")).alias("b"))
    return b.select(*TRUTH, (-_c("b.d")).alias("det"), _c("b.excess").alias("excess"), (_c("b.hi") - _c("b.lo")).alias("width_hz"))


def width_ratio(matched: DataFrame) -> DataFrame:
    return matched.withColumn("width_ratio", F.when(_c("hit"), (_c("best_hi") - _c("best_lo")) / (_c("hi") - _c("lo"))))


def bounds_stats(matched: DataFrame, keys: list[str]) -> DataFrame:
    w, no = _c("width_ratio"), F.lit(False)
    return matched.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        share(F.coalesce((w >= RATIO_LO) & (w <= RATIO_HI), no)).alias("ok_bounds"),
        share(F.coalesce(w > RATIO_HI, no)).alias("too_wide"), share(F.coalesce(w < RATIO_LO, no)).alias("too_narrow"),
        share(_c("n_overlap") > 1).alias("fragmented"))


def all_stats(rows: DataFrame, key: str) -> DataFrame:
    """Long table (key, stat, value, n) of the criteria statistics: one pass over the rows, one row per key between.
    The counts `n` and `n_noise`, which two families share, are taken once."""
    timed = _c("time_s").isNotNull()
    speed = [F.count_if(timed).alias("n_timed"), share(_c("time_s") <= SPEED_S, timed).alias("within")]
    a = flags(rows).groupBy(key).agg(*_label_shares(), *_rate_shares()[1:], *_confidence_shares(), *_detect_shares()[:2],
                                     *_detect_shares()[3:], *_param_shares(), *speed)
    names = {"label_wrong": "n", "label_correct": "n_in_library", "rate_wrong": "n", "rate_correct": "n_digital",
             "noise_labelled": "n_noise", "ool_wrong": "n_ool", "calibration_claims": "n_noise", "recall": "n_strong",
             "noise_false": "n_noise", "fragmentation": "n_found", "cf_ok": "n_linear", "bw3_ok": "n_linear", "snr_ok": "n_signal",
             "within": "n_timed"}
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), _c(k).cast("double").alias("value"), _c(n).alias("n"))
                                for k, n in names.items()])).alias("s")
    return a.select(key, items).select(key, "s.stat", "s.value", "s.n").where("stat <> 'within' OR n > 0")


def criteria(spark: SparkSession, stats: DataFrame, key: str = "gen") -> DataFrame:
    """Each criterion per generator; passed overall when it applies somewhere and holds wherever it applies."""
    crit = spark.createDataFrame([(i, s, t, lim, g) for i, s, t, lim, gens in CRITERIA for g in gens],
                                 f"id string, stat string, test string, bar double, {key} string")
    j = F.broadcast(crit).join(stats, ["stat", key], "left")
    ok = F.when(_c("test") == "<=", _c("value") <= _c("bar")).otherwise(_c("value") >= _c("bar"))
    j = j.withColumn("gen_passed", ok)
    w = W.partitionBy("id")
    return j.withColumn("passed", F.coalesce(F.bool_and("gen_passed").over(w), F.lit(False)))


def criteria_pivot(crit: DataFrame, gens: list[str]) -> DataFrame:
    return crit.groupBy("id", "passed").pivot("gen", gens).agg(F.first("value"))


def gen_marks(crit: DataFrame) -> DataFrame:
    return crit.groupBy("gen").agg(F.bool_and("gen_passed").alias("mark"), F.count("gen_passed").alias("n_applicable"))


def file_outcome(det: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Per file: an allowed label published, any other published, rates of allowed labels.

    `files` has allowed (array) and expected_rate per key; det has label and rate.
    """
    j = files.join(det, keys, "left")
    ok = F.exists("allowed", lambda a: label_matches(_c("label"), a))
    pub = _c("label").isNotNull()
    scored = _c("expected_rate").isNotNull()
    good = scored & pub & ok & rate_matches(_c("rate"), _c("expected_rate"))
    bad = scored & pub & ok & _c("rate").isNotNull() & ~rate_matches(_c("rate"), _c("expected_rate"))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return j.groupBy(*keys, F.size("allowed").alias("n_allowed"), scored.alias("rate_scored")).agg(
        any_(pub & ok).alias("correct"), any_(pub & ~ok).alias("wrong"), any_(bad).alias("rate_wrong"),
        any_(good).alias("rate_correct"), F.count("det").alias("n_detections"))


def file_stats(outcome: DataFrame) -> DataFrame:
    have, scored = _c("n_allowed") > 0, _c("rate_scored")
    return outcome.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(have).alias("n_with_label"),
                       F.count_if(scored).alias("n_rate_scored"), share(_c("correct"), have).alias("correct"),
                       share(_c("wrong")).alias("wrong"), share(_c("rate_wrong"), scored).alias("rate_wrong"),
                       share(_c("rate_correct"), scored).alias("rate_correct"))


def sanity_rules(det: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Per file the list of broken manifest rules; an empty list passes.

    files: min_detections, allowed, expected_rate, band_lo, band_hi, require_pulsed, bw_lo, bw_hi, wide_hz, wide_count.
    """
    j = files.join(det, keys, "left")
    seen = _c("det").isNotNull()
    in_list = F.array_contains("allowed", _c("label"))
    near = seen & (_c("band_lo").isNull() | ((_c("hi") > _c("band_lo")) & (_c("lo") < _c("band_hi"))))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rule_cols = [c for c in files.columns if c not in keys]
    a = j.groupBy(*keys, *rule_cols).agg(
        n(seen).alias("_n"), n(_c("label").isNotNull() & ~in_list).alias("_lab"),
        n(in_list & (F.abs(_c("rate") - _c("expected_rate")) / _c("expected_rate") > 0.05)).alias("_rate"),
        n(near).alias("_near"), n(near & _c("is_pulsed")).alias("_pulsed"),
        n(near & (_c("bw99") >= _c("bw_lo")) & (_c("bw99") <= _c("bw_hi"))).alias("_bw"),
        n(_c("bw99") >= _c("wide_hz")).alias("_wide"))
    notes = F.array_compact(F.array(
        F.when(_c("_n") < _c("min_detections"), F.lit("too few detections")),
        F.when(_c("_lab") > 0, F.lit("published label not allowed")),
        F.when(_c("_rate") > 0, F.lit("published rate off")),
        F.when(_c("band_lo").isNotNull() & (_c("_near") == 0), F.lit("no detection overlaps the band")),
        F.when(_c("require_pulsed") & (_c("_pulsed") == 0), F.lit("no pulsed detection where bursts are expected")),
        F.when(_c("bw_lo").isNotNull() & (_c("_bw") == 0), F.lit("no detection with the expected 99% bandwidth")),
        F.when(_c("wide_hz").isNotNull() & (_c("_wide") < _c("wide_count")), F.lit("too few wide detections"))))
    return a.select(*keys, notes.alias("notes")).withColumn("passed", F.size("notes") == 0)


BYTES_PER_SAMPLE = {"cf32_le": 8, "cf32_be": 8, "ci16_le": 4, "ci16_be": 4, "rf32_le": 4, "ri16_le": 2, "cu8": 2, "ci8": 2}


def realtime_factor(files: DataFrame, datatype: str, size: str, rate: str, wall_s: Column) -> DataFrame:
    bps = F.coalesce(*[F.when(_c(datatype) == k, F.lit(v)) for k, v in BYTES_PER_SAMPLE.items()])
    dur = F.sum(_c(size) / bps / _c(rate))
    return files.agg(F.count(F.lit(1)).alias("n_files"), dur.alias("duration_s"), F.sum(wall_s).alias("wall_s")) \
        .withColumn("rtf", ratio(_c("wall_s"), _c("duration_s")))


def accuracy_curve(rows: DataFrame, passed: Column) -> DataFrame:
    return rows.groupBy("kind", "snr_true").agg(F.count(F.lit(1)).alias("trials"), F.count_if(passed).alias("passed")) \
        .withColumn("accuracy", _c("passed") / _c("trials")).orderBy("kind", "snr_true")


def cause_table(df: DataFrame, group: str, cause: str) -> DataFrame:
    """Count and share of each cause inside its set; causes are few."""
    a = df.groupBy(group, cause).agg(F.count(F.lit(1)).alias("n"))
    return a.withColumn("share", _c("n") / F.sum("n").over(W.partitionBy(group))) \
            .withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), cause)))


def primary_per_file(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Highest-SNR detection of each file; a missing SNR counts as -99."""
    order = F.struct(F.coalesce("snr", F.lit(-99.0)).alias("s"), *[F.col(f) for f in fields])
    return rows.groupBy(*keys).agg(F.max(order).alias("b")).select(*keys, *[F.col(f"b.{f}").alias(f) for f in fields])


def snr_band(snr: Column) -> Column:
    s = F.coalesce(snr, F.lit(99.0))
    return F.when(s < 5, "<5").when(s < 10, "5..10").when(s < 15, "10..15").otherwise(">15")


def auc_pairs(df: DataFrame, value: str, good: Column, keys: list[str] | None = None) -> DataFrame:
    """P(value of a good row > value of a bad row), ties one half, by rank sums over distinct values."""
    keys = keys or []
    v = df.groupBy(*keys, F.col(value).alias("_x")).agg(F.count_if(good).alias("_g"), F.count_if(~good).alias("_b"))
    v = prefix_sums(v.withColumn("_bk", value_bucket(_c("_x"), FINE)), keys, "_bk", ["_x"], _cb=_c("_b"))
    wins = F.sum(_c("_g") * (_c("_cb") - _c("_b") + 0.5 * _c("_b")))
    a = v.groupBy(*keys).agg(F.sum("_g").alias("n_good"), F.sum("_b").alias("n_bad"), wins.alias("_w"))
    return a.select(*keys, "n_good", "n_bad", ratio(_c("_w"), _c("n_good").cast("double") * _c("n_bad")).alias("auc"))


def spread_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, p10 and p90 by sorted index (n // 10 and 9n // 10), shares outside [0.5, 2].

    Counts of distinct values are ranked, so a value that very many rows share is one row.
    """
    v = df.where(_c(value).isNotNull()).groupBy(*keys, _c(value).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    v = prefix_sums(v.withColumn("_bk", value_bucket(_c("_x"), FINE)), keys, "_bk", ["_x"], _end=_c("_n"))
    n = v.groupBy(*keys).agg(F.sum("_n").alias("n"))
    at = lambda num: F.floor(num * _c("n") / 10)
    pick = lambda num: F.max(F.when((_c("_end") > at(num)) & (_c("_end") - _c("_n") <= at(num)), _c("_x")))
    part = lambda cond: F.sum(F.when(cond, _c("_n")).otherwise(0)) / _c("n")
    a = v.join(n, keys).groupBy(*keys, "n").agg(pick(1).alias("p10"), pick(9).alias("p90"), part(_c("_x") > 2).alias("over_2"),
                                                part(_c("_x") < 0.5).alias("under_half"))
    return a.join(quantiles(df, keys, value, {"median": 0.5}), keys)


def ablation_effects(summary: DataFrame, cond: str = "condition", value: str = "correct") -> DataFrame:
    """cost = none - only:X, recovery = without:X - all."""
    s = summary.select(F.split_part(F.col(cond), F.lit(":"), F.lit(1)).alias("how"),
                       F.split_part(F.col(cond), F.lit(":"), F.lit(2)).alias("factor"), F.col(value).alias("v"))
    base = s.where(_c("factor") == "").agg(F.max(F.when(_c("how") == "none", _c("v"))).alias("none"),
                                           F.max(F.when(_c("how") == "all", _c("v"))).alias("all"))
    f = s.where(_c("factor") != "").groupBy("factor").agg(
        F.max(F.when(_c("how") == "only", _c("v"))).alias("only"), F.max(F.when(_c("how") == "without", _c("v"))).alias("without"))
    # one row on the base side
    return f.crossJoin(F.broadcast(base)).select("factor", (_c("none") - _c("only")).alias("cost"),
                                                 (_c("without") - _c("all")).alias("recovery"))


def stage_timing_table(long: DataFrame, budget: float) -> DataFrame:
    a = long.groupBy("stage").agg(F.avg("ms").alias("mean"), F.max("ms").alias("max"),
                                  F.count_if(_c("ms") > budget).alias("over_budget"))
    return a.join(quantiles(long, ["stage"], "ms", {"p50": 0.5, "p95": 0.95}), "stage")


def latest_runs(rows: DataFrame, keep: int = 10) -> DataFrame:
    """Latest entry of each job, newest first, `keep` of them."""
    cols = [c for c in rows.columns if c != "job_id"]
    last = rows.groupBy("job_id").agg(F.max(F.struct("ts", *[c for c in cols if c != "ts"])).alias("b"))
    return last.select("job_id", "b.*").orderBy(F.desc("ts"), "job_id").limit(keep)


def incremental_rows(cache: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Cached rows plus the fresh rows whose id is not cached."""
    return cache.unionByName(fresh.join(cache.select(key), key, "left_anti"))


def refresh_flags(rows: DataFrame, in_library: list[str], out_of_library: list[str]) -> DataFrame:
    return rows.withColumns({"in_library": _c("truth").isin(in_library), "out_of_library": _c("truth").isin(out_of_library)})


def tolerance_join(left: DataFrame, right: DataFrame, keys: list[str], tol: float = 1e-6, absolute: float = 1.0,
                   width: float = 64.0) -> DataFrame:
    """left_semi: rows whose two edges both agree with a right row within absolute + tol * |edge|.

    The right side is reduced to distinct edges and copied to the one or two bins its tolerance touches.
    """
    r = right.select(*keys, _c("lo").alias("r_lo"), _c("hi").alias("r_hi")).distinct()
    slack = absolute + tol * (F.abs(_c("r_lo")) + absolute) * 2
    r = r.withColumn("_bin", F.explode(F.sequence(F.floor((_c("r_lo") - slack) / width), F.floor((_c("r_lo") + slack) / width))))
    lft = left.withColumn("_bin", F.floor(_c("lo") / width))
    lim = lambda v: tol * F.greatest(F.lit(1.0), F.abs(v)) + absolute
    cond = [lft[k] == r[k] for k in keys] + [lft["_bin"] == r["_bin"], F.abs(r["r_lo"] - lft["lo"]) < lim(lft["lo"]),
                                             F.abs(r["r_hi"] - lft["hi"]) < lim(lft["hi"])]
    return lft.join(r, cond, "left_semi").drop("_bin")


def carson_ratio(bw: Column, split: Column, rate: Column) -> Column:
    return bw / (split + 2 * rate)


def stride_sample(rows: DataFrame, order: str, k: int, bucket: Column) -> DataFrame:
    """Every k-th row in id order: a sampling feature, numbered without a single global window."""
    return numbered(rows, [], bucket, [order], "_rn").where((_c("_rn") - 1) % k == 0).drop("_rn")
