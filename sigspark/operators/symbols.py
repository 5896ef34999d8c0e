"""Feed-forward symbol recovery as table jobs, and the gates before it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import cpow, rotate
from ..session import written
from .pulses import two_level_threshold

# fixed values: published label -> (method, minimum SNR in dB)
DECODERS = {"BPSK": ("psk", 10.0), "QPSK": ("psk", 10.0), "8PSK": ("psk", 15.0), "FSK2": ("fsk", 10.0), "ASK2": ("ask", 8.0)}
MIN_SPS = 4.0
FSK_MIN_CONFIDENCE, ASK_MIN_CONFIDENCE = 0.46, 0.55
MAX_DRIFT, MAX_RESIDUAL = 5e-4, 0.013
KEEP_SYMBOLS = 20_000


def symbol_epoch(df: DataFrame, keys: list[str], index: str, y: str, sps: float) -> DataFrame:
    """Symbol epoch from the 1/sps line of (y - mean)^2, and how much of it is that line."""
    m = df.groupBy(*keys).agg(F.avg(y).alias("_m"), F.var_pop(y).alias("_v"))
    ac = (F.col(y) - F.col("_m")) * (F.col(y) - F.col("_m")) - F.col("_v")
    a = F.col(index) * (2 * math.pi / sps)
    s = df.join(m, keys).groupBy(*keys).agg(F.sum(ac * F.cos(a)).alias("_c"), (-F.sum(ac * F.sin(a))).alias("_s"),
                                            F.sum(F.abs(ac)).alias("_t"), F.count(F.lit(1)).alias("length"))
    ph = -F.atan2("_s", "_c") / (2 * math.pi)
    return s.where((F.col("_t") > 0) & (F.col("length") >= sps)).select(
        *keys, "length", ((ph - F.floor(ph)) * sps).alias("tau"), F.least(F.lit(1.0), F.hypot("_c", "_s") / F.col("_t")).alias("lock"))


def integrate_and_dump(df: DataFrame, epochs: DataFrame, keys: list[str], index: str, values: list[str], sps: float) -> DataFrame:
    """Mean of each value over the sps-wide window of every symbol; incomplete end symbols are dropped.

    A sample looks only at the two or three symbols next to it, so this is an expression plus one aggregate.
    """
    win, half = round(sps), sps / 2
    x = df.join(epochs.select(*keys, "tau", "length"), keys)
    near = F.floor((F.col(index) - F.col("tau") + half) / sps)
    x = x.withColumn("k", F.explode(F.array(near - 1, near, near + 1)))
    centre = F.col("tau") + F.col("k") * sps
    lo = F.rint(centre - half)
    n_sym = F.floor((F.col("length") - F.col("tau")) / sps)
    x = x.where((F.col("k") >= 0) & (F.col("k") < n_sym) & (centre - half >= 0) & (centre + half <= F.col("length"))
                & (F.col(index) >= lo) & (F.col(index) < lo + win))
    return x.groupBy(*keys, "k").agg(*[F.avg(v).alias(v) for v in values])


def demap_fsk(symbols: DataFrame, keys: list[str], value: str, least: float = FSK_MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(bits, confidence per key); keys below the confidence floor are declined and give no bits."""
    m = symbols.groupBy(*keys).agg(F.avg(F.abs(value)).alias("_m"))
    c = symbols.join(m, keys).groupBy(*keys).agg(
        (1 - F.avg(F.abs(F.abs(value) - F.col("_m"))) / (F.max("_m") + 1e-30)).alias("confidence"), F.stddev_pop(value).alias("_s"))
    c = c.select(*keys, F.greatest("confidence", F.lit(0.0)).alias("confidence"), (F.col("_s") > 0).alias("_ok"))
    c = c.withColumn("decoded", F.col("_ok") & (F.col("confidence") >= least)).drop("_ok")
    bits = symbols.join(c.where("decoded").select(*keys), keys).select(*keys, "k", (F.col(value) > 0).cast("int").alias("bit"))
    return bits, c


def demap_ask(symbols: DataFrame, keys: list[str], value: str, least: float = ASK_MIN_CONFIDENCE, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(bits, confidence per key) by the two levels of a key. `symbols` (written or cheap to read) is read once per round.
    Keys below the confidence floor are declined and give no bits; so are keys of one value, whose confidence is NULL."""
    ends = written(symbols.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    lv = two_level_threshold(symbols, keys, value, ends.where("hi > lo"), rounds)
    x = symbols.join(lv, keys).withColumn("bit", (F.col(value) > F.col("threshold")).cast("int"))
    d = F.when(F.col("bit") == 1, F.abs(F.col(value) - F.col("hi"))).otherwise(F.abs(F.col(value) - F.col("lo")))
    c = x.groupBy(*keys).agg(F.greatest(F.lit(0.0), 1 - F.avg(d) / ((F.max("hi") - F.max("lo")) / 2)).alias("confidence"))
    c = c.withColumn("decoded", F.col("confidence") >= least)
    flat = ends.where(~F.coalesce(F.col("hi") > F.col("lo"), F.lit(False)))
    flat = flat.select(*keys, F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("decoded"))
    return x.join(c.where("decoded").select(*keys), keys).select(*keys, "k", "bit"), c.unionByName(flat)


def demap_psk(symbols: DataFrame, keys: list[str], order: int) -> tuple[DataFrame, DataFrame]:
    """Blind phase = arg(mean x^M)/M, nearest point index, and confidence from the mean angular error."""
    zr, zi = cpow(F.col("i"), F.col("q"), order)
    p = symbols.groupBy(*keys).agg(F.avg(zr).alias("_c"), F.avg(zi).alias("_s")).where((F.col("_c") != 0) | (F.col("_s") != 0))
    p = p.select(*keys, (F.atan2("_s", "_c") / order).alias("phase"))
    x = symbols.join(p, keys)
    re, im = rotate(F.col("i"), F.col("q"), F.col("phase") / (2 * math.pi))
    step = 2 * math.pi / order
    x = x.withColumn("_a", F.atan2(im, re)).withColumn("_r", F.rint(F.col("_a") / step))
    err = F.col("_a") - F.col("_r") * step
    x = x.withColumn("symbol", F.pmod(F.col("_r").cast("int"), F.lit(order))).withColumn("_e", F.abs(err))
    c = x.groupBy(*keys).agg(F.first("phase").alias("phase"), F.count(F.lit(1)).alias("n_symbols"),
                             F.greatest(F.lit(0.0), 1 - F.avg("_e") / (step / 2)).alias("confidence"))
    return x.select(*keys, "k", "symbol"), c


def decode_gate(label: Column, snr: Column, rate: Column, fs: Column, length: Column) -> Column:
    """Why a candidate is not decoded, or 'ready'."""
    method = F.coalesce(*[F.when(label == k, F.lit(m)) for k, (m, _) in DECODERS.items()])
    floor = F.coalesce(*[F.when(label == k, F.lit(s)) for k, (_, s) in DECODERS.items()])
    sps = fs / rate
    need = F.when(method == "psk", 2 * 2000 * sps).otherwise(2 * 32 * sps)
    return (F.when(label.isNull(), "not attempted (no published modulation label)")
             .when(method.isNull(), F.concat(F.lit("not attempted (no validated decoder for "), label, F.lit(")")))
             .when(snr.isNull(), "not attempted (unknown SNR)")
             .when(snr < floor, F.concat(F.lit("not attempted (SNR below validated "), F.format_string("%.1f", floor), F.lit(" dB gate)")))
             .when(rate.isNull() | (rate <= 0), "not attempted (no reliable symbol-rate estimate)")
             .when(sps < MIN_SPS, "not attempted (insufficient samples/symbol for timing recovery)")
             .when(length < need, "not attempted (segment too short)").otherwise("ready"))


def drift_lock(trace: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Offsets that follow a steady small drift: slope and residual deviation of a line fit, in one aggregate."""
    n = F.count(F.lit(1))
    a = trace.groupBy(*keys).agg(n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_syy(y, x).alias("_yy"),
                                 F.regr_sxy(y, x).alias("_xy"))
    resid = F.sqrt(F.greatest(F.col("_yy") - F.col("slope") * F.col("_xy"), F.lit(0.0)) / F.col("n"))
    return a.select(*keys, "n", "slope", resid.alias("residual"),
                    F.coalesce((F.abs("slope") <= MAX_DRIFT) & (resid < MAX_RESIDUAL), F.lit(False)).alias("locked"))


def align_sequences(decisions: DataFrame, truth: DataFrame, keys: list[str], max_shift: int = 3) -> DataFrame:
    """Smallest mismatch rate over start shifts and both polarities.

    Each decision row meets its truth bit under the 2 * max_shift + 1 shifts by equi-join; both polarities come
    from one mismatch count.
    """
    d = decisions.withColumn("shift", F.explode(F.sequence(F.lit(-max_shift), F.lit(max_shift))))
    d = d.withColumn("_t", F.col("k") + F.col("shift"))
    t = truth.select(*keys, F.col("k").alias("_t"), F.col("bit").alias("_b"))
    c = d.join(t, [*keys, "_t"]).groupBy(*keys, "shift").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bit") != F.col("_b")).alias("e"))
    return c.groupBy(*keys).agg(F.min(F.least(F.col("e"), F.col("n") - F.col("e")) / F.col("n")).alias("error_rate"))


def truncate_symbols(symbols: Column, keep: int = KEEP_SYMBOLS) -> tuple[Column, Column, Column]:
    """(shown, full count, truncated flag): a display limit; the full array stays in the table."""
    n = F.size(symbols)
    return F.slice(symbols, 1, keep), n, n > keep


def symbol_text_rows(df: DataFrame, keys: list[str], symbols: str, row: int = 64, group: int = 8) -> DataFrame:
    """Text lines of 64 symbols in groups of 8."""
    x = df.select(*keys, F.posexplode(symbols).alias("p", "s"))
    g = x.groupBy(*keys, F.floor(F.col("p") / row).alias("line")).agg(F.array_sort(F.collect_list(F.struct("p", "s"))).alias("a"))
    txt = F.array_join(F.transform("a", lambda c: F.concat(
        F.when((c["p"] % row > 0) & (c["p"] % group == 0), F.lit(" ")).otherwise(F.lit("")), c["s"].cast("string"))), "")
    return g.select(*keys, "line", txt.alias("text"))


def decode_span(start: Column, end: Column, budget: Column, label: Column, spans: Column) -> Column:
    """Samples to decode: the whole track within the budget, else one budget from the first span that published
    the track's label, clamped to the end; NULL when no span did."""
    hit = F.get(F.filter(spans, lambda s: s["label"] == label), F.lit(0))
    a = F.least(hit["start_sample"], end - budget)
    long_ = F.when(hit.isNotNull(), F.struct(a.alias("start_sample"), (a + budget).alias("end_sample")))
    return F.when(label.isNotNull(), F.when(end - start <= budget, F.struct(start.alias("start_sample"), end.alias("end_sample"))).otherwise(long_))


def symbol_frequency(samples: DataFrame, keys: list[str], index: str, sps: float, rate: float, tau: float = 0.0) -> DataFrame:
    """Per symbol the angle of the summed x[n+1] * conj x[n], over samples more than one away from its edges."""
    from .partitioning import halo, halo_window
    x = halo(samples, keys, index, 1 << 16, 0, 1)
    w = halo_window(keys, index)
    x = x.withColumns({"_ni": F.lead("i").over(w), "_nq": F.lead("q").over(w), "_nn": F.lead(index).over(w)})
    x = x.where(F.col("core") & (F.col("_nn") == F.col(index) + 1))
    u = F.col(index) / sps + tau
    frac = u - F.floor(u)
    x = x.withColumn("k", F.floor(u)).where((frac * sps > 1) & ((1 - frac) * sps > 1))
    re = F.col("_ni") * F.col("i") + F.col("_nq") * F.col("q")
    im = F.col("_nq") * F.col("i") - F.col("_ni") * F.col("q")
    return x.groupBy(*keys, "k").agg((F.atan2(F.sum(im), F.sum(re)) * (rate / (2 * math.pi))).alias("frequency_hz"))
