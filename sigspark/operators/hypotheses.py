"""Hypothesis scores, margins between them, publication gates and votes."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import cpow, ratio, rotate
from .partitioning import halo, halo_window

# fixed values
UNKNOWN_CE = "unknown constant-envelope"
FAMILY = {"BPSK": "PSK", "QPSK": "PSK", "8PSK": "PSK", "QAM16": "QAM16", "FSK2": "FSK", "FSK4": "FSK",
          "FSK8": UNKNOWN_CE, "ASK2": "ASK", "AM": "AM", "FM": "FM", "none": "none"}
DIGITAL = ("nrz", "rrc", "lsp", "fsk")
RATELESS = ("keyed",)
MIN_INBAND = 0.5
UNKNOWN_TEXT = "does not fit the clean models (impairment or unknown family)"
TIER_TEXT = {"labelled": "estimated (label margin passed)", "unknown_family": UNKNOWN_TEXT,
             "abstain": "not reliably estimated (margins below thresholds)"}
INBAND_STEPS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
_TINY = 1e-30


@dataclass(frozen=True)
class Thresholds:
    """Fitted margins (fixed values); margins are nats per sample."""
    m_fam: float = 0.167533
    m_rate: float = 0.004518
    unexplained_max: float = 0.11922221951364399
    min_usage: float = 0.01
    m_fm_digital: float = 0.711137
    m_label: float = 0.183238
    unit: str = "sample"


def pick(c: Column, table: dict) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()])


def family_of(label: Column) -> Column:
    return pick(label, FAMILY)


# --- scores from samples -------------------------------------------------------------------------------------

def score_null(samples: DataFrame, keys: list[str]) -> DataFrame:
    p = F.col("i") * F.col("i") + F.col("q") * F.col("q")
    return samples.groupBy(*keys).agg(F.log(F.avg(p)).alias("score"))


def symbol_means(samples: DataFrame, keys: list[str], index: str, rates: list[float], rate: float,
                 tau: Column | float = 0.0) -> DataFrame:
    """Per candidate rate and symbol: count, mean and squared error about the mean; partial end symbols dropped.

    Samples are combined to symbols on the map side before anything is shuffled.
    """
    t = tau if isinstance(tau, Column) else F.lit(tau)
    x = samples.withColumn("rate", F.explode(F.array(*[F.lit(float(v)) for v in rates])))
    x = x.withColumn("k", F.floor(F.col(index) * F.col("rate") / rate + t))
    p = F.col("i") * F.col("i") + F.col("q") * F.col("q")
    s = x.groupBy(*keys, "rate", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("_i"), F.sum("q").alias("_q"), F.sum(p).alias("_p"))
    ends = s.groupBy(*keys, "rate").agg(F.min("k").alias("_k0"), F.max("k").alias("_k1"))
    s = s.join(ends, [*keys, "rate"]).where((F.col("k") > F.col("_k0")) & (F.col("k") < F.col("_k1")))
    return s.select(*keys, "rate", (F.col("k") - F.col("_k0") - 1).alias("k"), "n", (F.col("_i") / F.col("n")).alias("re"),
                    (F.col("_q") / F.col("n")).alias("im"),
                    (F.col("_p") - (F.col("_i") * F.col("_i") + F.col("_q") * F.col("_q")) / F.col("n")).alias("sse"))


def score_flat_rates(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """Mean power around per-symbol means for each rate."""
    return symbols.groupBy(*keys, "rate").agg((F.sum("sse") / F.sum("n")).alias("score"), F.count(F.lit(1)).alias("n_symbols"))


def _points(order: int) -> list[tuple[float, float]]:
    if order == 2:
        return [(1.0, 0.0), (-1.0, 0.0)]
    if order == 4:
        s = 1 / math.sqrt(2)
        return [(s, s), (s, -s), (-s, s), (-s, -s)]
    if order == 8:
        return [(math.cos(2 * math.pi * k / 8), math.sin(2 * math.pi * k / 8)) for k in range(8)]
    lv = (-3.0, -1.0, 1.0, 3.0)
    return [(a / math.sqrt(10), b / math.sqrt(10)) for a in lv for b in lv]


PSK_LABEL = {2: "BPSK", 4: "QPSK", 8: "8PSK", 16: "QAM16"}


def score_alphabets(symbols: DataFrame, keys: list[str], orders=(2, 4, 8, 16), block: int = 32) -> DataFrame:
    """Snap symbol means to each alphabet with one amplitude and phase per block of symbols.

    Blocks of `block` symbols are the window partitions, so work per task is fixed; residuals come from the
    symbol table alone (error about the mean plus the mean's distance to its point).
    """
    out = None
    for order in orders:
        pts = _points(order)
        m = 8 if order == 8 else 2 if order == 2 else 4
        zr, zi = cpow(F.col("re"), F.col("im"), m)
        sign = -1.0 if m == 4 else 1.0
        w = W.partitionBy(*keys, "rate", "_b")
        x = symbols.withColumn("_b", F.floor(F.col("k") / block))
        mean_pt = sum(math.hypot(a, b) for a, b in pts) / len(pts)
        x = x.withColumn("_amp", F.avg(F.hypot("re", "im")).over(w) / mean_pt + 1e-12)
        x = x.withColumn("_th", F.atan2(sign * F.sum(zi).over(w), sign * F.sum(zr).over(w)) / m)
        ur, ui = rotate(F.col("re"), F.col("im"), F.col("_th") / (2 * math.pi))
        x = x.withColumns({"_ur": ur / F.col("_amp"), "_ui": ui / F.col("_amp")})
        d2 = [F.struct(((F.col("_ur") - a) * (F.col("_ur") - a) + (F.col("_ui") - b) * (F.col("_ui") - b)).alias("d"), F.lit(j).alias("j"))
              for j, (a, b) in enumerate(pts)]
        x = x.withColumn("_best", F.array_min(F.array(*d2)))
        res = F.col("sse") + F.col("n") * F.col("_amp") * F.col("_amp") * F.col("_best.d")
        x = x.withColumn("_res", res).withColumn("idx", F.col("_best.j"))
        per = x.groupBy(*keys, "rate", "idx").agg(F.count(F.lit(1)).alias("_c"), F.sum("_res").alias("_r"), F.sum("n").alias("_n"))
        a = per.groupBy(*keys, "rate").agg(F.sum("_c").alias("n_symbols"), F.sum("_r").alias("_r"), F.sum("_n").alias("_n"),
                                           F.when(F.count(F.lit(1)) == order, F.min("_c")).otherwise(F.lit(0)).alias("least"))
        resid = F.col("_r") / F.col("_n") + _TINY
        code = F.col("n_symbols") * math.log(order) + F.ceil(F.col("n_symbols") / block) * F.log(F.col("_n").cast("double"))
        a = a.select(*keys, "rate", F.lit(PSK_LABEL[order]).alias("label"), (F.log(resid) + code / F.col("_n")).alias("score"),
                     resid.alias("residual"), "n_symbols", alphabet_usage(F.col("least"), F.col("n_symbols"), order).alias("usage"))
        out = a if out is None else out.unionByName(a)
    return out


def score_ask(symbols: DataFrame, keys: list[str], block: int = 32, rounds: int = 8) -> DataFrame:
    """Two unipolar amplitude levels: block phase removed, levels fitted over all symbols of the segment."""
    from .partitioning import quantiles
    w = W.partitionBy(*keys, "rate", "_b")
    x = symbols.withColumn("_b", F.floor(F.col("k") / block))
    zr, zi = cpow(F.col("re"), F.col("im"), 2)
    x = x.withColumn("_th", F.atan2(F.sum(zi).over(w), F.sum(zr).over(w)) / 2)
    ur, ui = rotate(F.col("re"), F.col("im"), F.col("_th") / (2 * math.pi))
    x = x.withColumns({"_ur": ur, "_ui": ui})
    x = x.withColumn("_flip", F.when(F.sum("_ur").over(w) < 0, -1.0).otherwise(1.0))
    x = x.select(*keys, "rate", "k", "n", "sse", (F.col("_ur") * F.col("_flip")).alias("r"), (F.col("_ui") * F.col("_flip")).alias("o"))
    kk = [*keys, "rate"]
    state = quantiles(x, kk, "r", {"lo": 0.25, "hi": 0.75})
    for _ in range(rounds):
        low = F.col("r") <= (F.col("lo") + F.col("hi")) / 2
        state = x.join(state, kk).groupBy(*kk, "lo", "hi").agg(F.avg(F.when(low, F.col("r"))).alias("_l"), F.avg(F.when(~low, F.col("r"))).alias("_h"))
        state = state.select(*kk, F.greatest(F.coalesce("_l", "lo"), F.lit(0.0)).alias("lo"), F.greatest(F.coalesce("_h", "hi"), F.lit(0.0)).alias("hi"))
    low = F.col("r") <= (F.col("lo") + F.col("hi")) / 2
    lv = F.when(low, F.col("lo")).otherwise(F.col("hi"))
    res = F.col("sse") + F.col("n") * ((F.col("r") - lv) * (F.col("r") - lv) + F.col("o") * F.col("o"))
    a = x.join(state, kk).groupBy(*kk).agg(F.count(F.lit(1)).alias("n_symbols"), F.sum("n").alias("_n"), F.sum(res).alias("_r"),
                                           F.least(F.count_if(low), F.count_if(~low)).alias("least"))
    resid = F.col("_r") / F.col("_n") + _TINY
    logn = F.log(F.col("_n").cast("double"))
    code = F.col("n_symbols") * math.log(2) + F.ceil(F.col("n_symbols") / block) * logn + logn
    return a.select(*kk, F.lit("ASK2").alias("label"), (F.log(resid) + code / F.col("_n")).alias("score"), resid.alias("residual"),
                    "n_symbols", alphabet_usage(F.col("least"), F.col("n_symbols"), 2).alias("usage"))


def symbol_timing_phase(samples: DataFrame, keys: list[str], index: str, symbol_rate: float, rate: float, block: int = 1 << 16) -> DataFrame:
    """Phase of the symbol-rate line of |x[n+1] - x[n]|^2, as a fraction of a symbol."""
    x = halo(samples, keys, index, block, 1, 0)
    w = halo_window(keys, index)
    x = x.withColumns({"_pi": F.lag("i").over(w), "_pq": F.lag("q").over(w), "_pn": F.lag(index).over(w)})
    x = x.where(F.col("core") & (F.col("_pn") == F.col(index) - 1))
    g = (F.col("i") - F.col("_pi")) * (F.col("i") - F.col("_pi")) + (F.col("q") - F.col("_pq")) * (F.col("q") - F.col("_pq"))
    a = F.col(index) * (2 * math.pi * symbol_rate / rate)
    s = x.groupBy(*keys).agg(F.sum(g * F.cos(a)).alias("_c"), (-F.sum(g * F.sin(a))).alias("_s"))
    t = F.atan2("_s", "_c") / (2 * math.pi)
    return s.select(*keys, (t - F.floor(t)).alias("phase"))


def alphabet_usage(least: Column, n: Column, order: int) -> Column:
    """P-value of the least-used point: 1 - (1 - PoissonCDF(least; n/order))^order, summed in logs."""
    lam = n / F.lit(float(order))
    start = F.struct((-lam).alias("t"), F.exp(-lam).alias("s"))
    step = lambda a, j: F.struct((a["t"] + F.log(lam) - F.log(j.cast("double"))).alias("t"),
                                 (a["s"] + F.exp(a["t"] + F.log(lam) - F.log(j.cast("double")))).alias("s"))
    js = F.when(least > 0, F.sequence(F.lit(1), least.cast("int"))).otherwise(F.array().cast("array<int>"))
    cdf = F.aggregate(js, start, step, lambda a: a["s"])
    return F.when(n > 0, 1 - F.pow(1 - F.least(cdf, F.lit(1.0)), F.lit(float(order)))).otherwise(0.0)


# --- decisions -----------------------------------------------------------------------------------------------

FIELDS = ["expert", "label", "rate", "residual", "usage", "family"]
MARGINS = ["_fam", "_lab", "_null", "_dig", "_rate"]


def _rivals(best: Callable[[str], Column], rate_tol: float) -> list[Column]:
    """Which hypotheses are the rivals of each of `MARGINS`."""
    dig = F.col("expert").isin(*DIGITAL)
    far = F.abs(F.col("rate") - best("rate")) / best("rate") >= rate_tol
    return [F.col("family") != best("family"), F.col("label") != best("label"), F.col("expert") == "null",
            F.col("expert").isin(*DIGITAL, *RATELESS), dig & far]


def mdl_winner(hyps: DataFrame, info: DataFrame, keys: list[str], rate_tol: float = 0.05) -> DataFrame:
    """Best hypothesis per candidate and its margins over rivals of other families, labels and rates.

    No rival means 0 for m_fam and m_rate, +inf for the others; m_rate is NULL for non-digital winners and
    unexplained is NULL when the null model wins. Two aggregates; the winner row is joined back one per key.
    """
    h = hyps.withColumn("family", family_of(F.col("label")))
    best = h.groupBy(*keys).agg(F.min(F.struct("score", *FIELDS)).alias("b"))
    best = best.select(*keys, F.col("b.score").alias("best_score"), *[F.col(f"b.{f}").alias(f"best_{f}") for f in FIELDS])
    cols = ["best_score", *[f"best_{f}" for f in FIELDS]]
    conds = _rivals(lambda f: F.col(f"best_{f}"), rate_tol)
    a = h.join(best, keys).groupBy(*keys, *cols).agg(*[F.min(F.when(c, F.col("score"))).alias(n) for n, c in zip(MARGINS, conds)])
    a = a.join(info, [k for k in keys if k in info.columns])
    return _margins(a, keys, [c for c in info.columns if c not in keys])


def _margins(a: DataFrame, keys: list[str], more: list[str]) -> DataFrame:
    """The margins of winners over the least scores of their rivals."""
    inf, b = F.lit(float("inf")), F.col("best_score")
    return a.select(
        *keys, "best_score", *[f"best_{f}" for f in FIELDS], *more, F.coalesce(F.col("_fam") - b, F.lit(0.0)).alias("m_fam"),
        F.coalesce(F.col("_null") - b, inf).alias("m_null"),
        F.when(F.col("best_expert").isin(*DIGITAL), F.coalesce(F.col("_rate") - b, F.lit(0.0))).alias("m_rate"),
        F.coalesce(F.col("_lab") - b, inf).alias("m_label"), F.coalesce(F.col("_dig") - b, inf).alias("m_fm_digital"),
        F.when(F.col("best_family") != "none", unexplained_share(F.col("best_residual"), F.col("noise_var"), F.col("total_power")))
        .alias("unexplained"))


def unexplained_share(residual: Column, noise: Column, total: Column) -> Column:
    return F.greatest(residual - noise, F.lit(0.0)) / F.greatest(total - noise, F.lit(1e-12))


def _limits(th: Thresholds | Column) -> dict[str, Column]:
    if isinstance(th, Thresholds):
        return {k: F.lit(v) for k, v in asdict(th).items()}
    return {k: th[k] for k in asdict(Thresholds())}


def gate(dec: DataFrame, th: Thresholds | Column = Thresholds()) -> DataFrame:
    """Publish label and rate when the margins, in the calibrated unit, reach their thresholds."""
    t, no = _limits(th), F.lit(False)
    ok = lambda c: F.coalesce(c, no)
    scale = F.when(t["unit"] == "sample", F.lit(1.0)).when(t["unit"] == "symbol", F.col("fs") / F.col("best_rate")) \
        .otherwise(F.col("n_samples").cast("double"))
    fam = ok((F.col("best_family") != "none") & (F.col("m_fam") * scale >= t["m_fam"]))
    fam = fam & ((F.col("best_label") != "FM") | ok(F.col("m_fm_digital") * scale >= t["m_fm_digital"]))
    lab = (fam & ok(F.col("unexplained") <= t["unexplained_max"]) & (F.col("best_family") != UNKNOWN_CE)
           & ok(F.col("best_usage") >= t["min_usage"]) & ok(F.col("m_label") * scale >= t["m_label"]))
    rate = lab & F.col("best_expert").isin(*DIGITAL) & ok(F.col("m_rate") * scale >= t["m_rate"])
    return dec.withColumns({"label_published": lab, "rate_published": rate,
                            "tier": F.when(lab, "labelled").when(fam, "unknown_family").otherwise("abstain")})


def tier_text(tier: Column, family: Column) -> tuple[Column, Column]:
    """(status text, family text) of a tier."""
    fam = F.when(tier == "labelled", family).when(tier == "unknown_family", F.when(
        family == UNKNOWN_CE, F.lit("unknown constant-envelope family")).otherwise(F.lit(UNKNOWN_TEXT)))
    return pick(tier, TIER_TEXT), fam


def inband_guard(dec: DataFrame, share: str, least: float = MIN_INBAND) -> DataFrame:
    """Withdraw a published label when most of the analysed power lies outside the candidate band."""
    out = F.col("label_published") & (F.col(share) < least)
    why = F.concat(F.lit("not reliably estimated (only "), F.rint(F.col(share) * 100).cast("int").cast("string"),
                   F.lit("% of the analysed power is inside the candidate band; the fit describes signal outside it)"))
    return dec.withColumns({"status": F.when(out, why).otherwise(pick(F.col("tier"), TIER_TEXT)),
                            "tier": F.when(out, F.lit("abstain")).otherwise(F.col("tier")),
                            "label_published": F.col("label_published") & ~out, "rate_published": F.col("rate_published") & ~out})


def first_failing_gate(th: Thresholds = Thresholds(), status: Column | None = None) -> Column:
    """Why nothing was published: causes named in the status, then the first failed of seven ordered gates."""
    fails = lambda c: ~F.coalesce(c, F.lit(False))
    gates = (F.when(F.col("best_family") == "none", "null_wins").when(F.col("best_family") == UNKNOWN_CE, "unknown_ce")
             .when(fails(F.col("m_fam") >= th.m_fam), "m_fam")
             .when((F.col("best_label") == "FM") & fails(F.col("m_fm_digital") >= th.m_fm_digital), "fm_digital")
             .when(fails(F.col("unexplained") <= th.unexplained_max), "unexplained")
             .when(fails(F.col("best_usage") >= th.min_usage), "usage").when(fails(F.col("m_label") >= th.m_label), "m_label"))
    if status is None:
        return gates
    # fixed values: status phrase -> cause, in order
    causes = [("requires complex IQ", "not_iq"), ("sampled spans disagree", "span_disagree"), ("fewer than half", "span_minority"),
              ("could not be analysed", "analysis_failed"), ("pulsed", "pulsed"), ("insufficient occupied samples", "short_segment")]
    return F.coalesce(*[F.when(F.contains(status, F.lit(p)), F.lit(c)) for p, c in causes], gates)


def redecide(hyps: DataFrame, info: DataFrame, keys: list[str], variants: list[tuple[str, Thresholds, tuple[str, ...]]],
             rate_tol: float = 0.05) -> DataFrame:
    """Decisions of stored hypotheses under other thresholds or expert subsets.

    Every variant is a set of columns of the same two aggregates, so a hypothesis is shuffled once; the variants become
    rows when only one row per candidate is left.
    """
    h = hyps.withColumn("family", family_of(F.col("label")))
    used = [F.col("expert").isin(*active, "null") for _, _, active in variants]
    best = h.groupBy(*keys).agg(*[F.min(F.when(u, F.struct("score", *FIELDS))).alias(f"_b{k}") for k, u in enumerate(used)])
    mins = [F.min(F.when(u & c, F.col("score"))).alias(f"{n}{k}") for k, u in enumerate(used)
            for n, c in zip(MARGINS, _rivals(lambda f, k=k: F.col(f"_b{k}.{f}"), rate_tol))]
    a = h.join(best, keys).groupBy(*keys).agg(*[F.first(f"_b{k}").alias(f"_b{k}") for k in range(len(variants))], *mins)
    v = F.array(*[F.struct(F.lit(n).alias("variant"), F.struct(*[F.lit(x).alias(f) for f, x in asdict(th).items()]).alias("th"),
                           F.col(f"_b{k}").alias("b"), *[F.col(f"{m}{k}").alias(m) for m in MARGINS])
                  for k, (n, th, _) in enumerate(variants)])
    kept = [c for c in info.columns if c not in keys]
    x = a.join(info, [k for k in keys if k in info.columns]).select(*keys, *kept, F.explode(F.filter(v, lambda w: w["b"].isNotNull())).alias("_v"))
    x = x.select(*keys, *kept, "_v.variant", F.col("_v.th").alias("_th"), F.col("_v.b.score").alias("best_score"),
                 *[F.col(f"_v.b.{f}").alias(f"best_{f}") for f in FIELDS], *[f"_v.{m}" for m in MARGINS])
    return gate(_margins(x, [*keys, "variant"], [*kept, "_th"]), F.col("_th")).drop("_th")


def burst_vote(bursts: DataFrame, joined: DataFrame, keys: list[str]) -> DataFrame:
    """Label of a pulsed candidate from its bursts (at most eight) and its joined segment, under four rules."""
    a = bursts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count("label").alias("_got"),
                                  F.min("label").alias("_lo"), F.max("label").alias("_hi"))
    x = a.join(joined, keys, "left")
    agree = F.when((F.col("_got") >= 2) & (F.col("_lo") == F.col("_hi")) & (F.col("_got") >= F.col("_n") / 2), F.col("_lo"))
    clean = (F.col("_got") == 0) | ((F.col("_lo") == F.col("joined")) & (F.col("_hi") == F.col("joined")))
    quiet = F.when(F.col("joined").isNotNull() & clean, F.col("joined"))
    either = F.when(quiet.isNotNull() & agree.isNotNull() & (quiet != agree), F.lit(None)).otherwise(F.coalesce(quiet, agree))
    return x.select(*keys, "joined", agree.alias("agree"), quiet.alias("joined_noconflict"), either.alias("joined_or_agree"))


def inband_sweep(labels: DataFrame, files: DataFrame, key: str, steps=INBAND_STEPS) -> DataFrame:
    """Correct and wrong file shares when labels need an in-band share >= s.

    labels: key, ok, share. Per file only the largest share of a right and of a wrong label matter, so files are
    reduced before the steps are multiplied in.
    """
    m = labels.groupBy(key).agg(F.max(F.when(F.col("ok"), F.col("share"))).alias("_ok"), F.max(F.when(~F.col("ok"), F.col("share"))).alias("_bad"))
    x = files.join(m, key, "left").withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
    hit = lambda c: F.coalesce(F.col(c) >= F.col("step"), F.lit(False))
    return x.groupBy("step").agg(F.count(F.lit(1)).alias("files"), F.count_if("has_allowed").alias("with_label"),
                                 ratio(F.count_if(F.col("has_allowed") & hit("_ok")), F.count_if("has_allowed")).alias("correct"),
                                 ratio(F.count_if(hit("_bad")), F.count(F.lit(1))).alias("wrong"))


def rate_multiple_check(decisions: DataFrame, keys: list[str], share: float = 0.85, least: int = 20, block: int = 1 << 16) -> DataFrame:
    """m > 1 when symbol decisions change (almost) only on one residue of k mod m: the rate is m times too high."""
    x = halo(decisions, keys, "k", block, 1, 0)
    w = halo_window(keys, "k")
    x = x.withColumns({"_p": F.lag("decision").over(w), "_pk": F.lag("k").over(w)})
    ch = x.where(F.col("core") & (F.col("_pk") == F.col("k") - 1) & (F.col("_p") != F.col("decision")))
    c = lambda m, r_: F.count_if(F.col("k") % m == r_)
    a = ch.groupBy(*keys).agg(F.count(F.lit(1)).alias("changes"), F.greatest(c(3, 0), c(3, 1), c(3, 2)).alias("_m3"),
                              F.greatest(c(2, 0), c(2, 1)).alias("_m2"))
    m = F.when(F.col("changes") < least, 1).when(F.col("_m3") >= share * F.col("changes"), 3) \
        .when(F.col("_m2") >= share * F.col("changes"), 2).otherwise(1)
    return a.select(*keys, "changes", m.alias("multiple"))


# --- user-supplied experts -----------------------------------------------------------------------------------

HYP_SCHEMA = "candidate long, expert string, label string, rate double, score double, residual double, usage double"
_EXPERTS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def register_expert(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    """Add a model: fn(one bounded segment's samples) -> rows label, rate, score, residual, usage."""
    _EXPERTS[name] = fn


def run_experts(segments: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Hypotheses of every registered expert; one group is one bounded segment (candidate, n, i, q, fs)."""
    chosen = {n: _EXPERTS[n] for n in (names or list(_EXPERTS))}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("n")
        parts = [f(p).assign(candidate=p.candidate.iloc[0], expert=n) for n, f in chosen.items()]
        return pd.concat(parts)[[c.split()[0] for c in HYP_SCHEMA.split(", ")]]
    return segments.groupBy("candidate").applyInPandas(fit, HYP_SCHEMA)
