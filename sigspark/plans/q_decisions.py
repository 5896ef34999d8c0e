"""Registered queries: hypothesis scores, margins, gates, votes, symbol recovery."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import features as FE, hypotheses as K, measure as H, partitioning as PT, pulses as P, symbols as L
from . import views as V
from .q_measure import CB, _core_blocks, _samples, rnd
from .registry import query
from .views import sql

TH = K.Thresholds()
RATES = [1000.0, 2000.0, 4000.0]
SPS = 8.0


def _local(spark, d):
    """Samples with their index inside the 800-sample stretch."""
    return _samples(spark, d).withColumn("idx", F.col("n") % V.BLOCK)


@query("score_null", sql("SELECT capture_id, blk, round(ln(avg(i*i+q*q)),6)+0.0 AS score FROM (SELECT *, n//800 AS blk FROM iq) GROUP BY ALL", "iq"))
def _(spark, d):
    return rnd(K.score_null(_samples(spark, d), CB), "score")


_SYM = """SELECT s.capture_id, s.blk, s.rate, s.k-k0-1 AS k, n, si/n AS re, sq/n AS im, pp-(si*si+sq*sq)/n AS sse FROM sym0 s JOIN (SELECT capture_id, blk, rate, min(k) AS k0, max(k) AS k1 FROM sym0 GROUP BY ALL) e
  ON s.capture_id=e.capture_id AND s.blk=e.blk AND s.rate=e.rate AND s.k>k0 AND s.k<k1"""
_SYM0 = """SELECT capture_id, blk, rate, floor(idx*rate/32000.0+0.25)::BIGINT AS k, count(*) AS n, sum(i) AS si, sum(q) AS sq, sum(i*i+q*q) AS pp FROM (
  SELECT capture_id, n//800 AS blk, n%800 AS idx, i, q, unnest([1000.0,2000.0,4000.0]::DOUBLE[]) AS rate FROM iq) GROUP BY ALL"""
SYM = {"sym0": _SYM0, "sym": _SYM}


def _sym(spark, d):
    return K.symbol_means(_local(spark, d), CB, "idx", RATES, V.FS, 0.25)


@query("score_flat_rates", sql("SELECT capture_id, blk, rate, round(sum(sse)/sum(n),8) AS score, count(*) AS n_symbols FROM sym GROUP BY ALL", "iq", **SYM))
def _(spark, d):
    return rnd(K.score_flat_rates(_sym(spark, d), CB), "score", digits=8)


def _snap(order):
    pts = K._points(order)
    m = 8 if order == 8 else 2 if order == 2 else 4
    sign = "-" if m == 4 else ""
    mean_pt = sum(math.hypot(a, b) for a, b in pts) / len(pts)
    z = {2: ("re*re-im*im", "2*re*im")}
    z[4] = (f"pow({z[2][0]},2)-pow({z[2][1]},2)", f"2*({z[2][0]})*({z[2][1]})")
    z[8] = (f"pow({z[4][0]},2)-pow({z[4][1]},2)", f"2*({z[4][0]})*({z[4][1]})")
    plist = "[" + ",".join(f"[{a!r}::DOUBLE,{b!r}::DOUBLE,{j}::DOUBLE]" for j, (a, b) in enumerate(pts)) + "]"
    return f"""SELECT capture_id, blk, rate, '{K.PSK_LABEL[order]}' AS label, {order} AS ord, sum(c)::BIGINT AS n_symbols, sum(rs) AS rs, sum(nn) AS nn, CASE WHEN count(*)={order} THEN min(c) ELSE 0 END AS least FROM (
      SELECT capture_id, blk, rate, best[2] AS j, count(*) AS c, sum(sse+n*amp*amp*best[1]) AS rs, sum(n) AS nn FROM (
      SELECT *, list_min(list_transform({plist}, lambda p: [pow((re*cos(th)+im*sin(th))/amp-p[1],2)+pow((im*cos(th)-re*sin(th))/amp-p[2],2), p[3]])) AS best FROM (
      SELECT *, avg(sqrt(re*re+im*im)) OVER w/{mean_pt!r}+1e-12 AS amp, atan2({sign}sum({z[m][1]}) OVER w, {sign}sum({z[m][0]}) OVER w)/{m} AS th FROM sym WINDOW w AS (PARTITION BY capture_id, blk, rate, k//32)))
      GROUP BY ALL) GROUP BY capture_id, blk, rate"""


_ALPH = " UNION ALL ".join(f"({_snap(o)})" for o in (2, 4, 8, 16))
_USE = "1-pow(1-least(list_sum(list_transform(range(0,{c}+1), lambda j: exp(-({n}/{o})+j*ln({n}/{o})-lgamma(j+1)))),1.0),{o})"


@query("score_alphabets", sql(f"""SELECT capture_id, blk, rate, label, n_symbols, round(ln(rs/nn+1e-30)+(n_symbols*ln(ord)+ceil(n_symbols/32)*ln(nn))/nn,6)+0.0 AS score,
  round(rs/nn+1e-30,8) AS residual, round({_USE.format(c='least', n='(n_symbols::DOUBLE)', o='ord')},6)+0.0 AS usage FROM alph""", "iq", **SYM, alph=_ALPH))
def _(spark, d):
    a = K.score_alphabets(_sym(spark, d), CB)
    return a.select(*CB, "rate", "label", "n_symbols", r(F.col("score")).alias("score"), r(F.col("residual"), 8).alias("residual"), r(F.col("usage")).alias("usage"))


@query("score_ask")
def _(spark, d):
    return rnd(K.score_ask(_sym(spark, d), CB), "score", "residual", "usage")


@query("symbol_timing_phase", sql("""SELECT capture_id, round(CASE WHEN ph<0 THEN ph+1 ELSE ph END,6)+0.0 AS phase FROM (SELECT capture_id, atan2(-sum(g*sin(a)),sum(g*cos(a)))/(2*pi()) AS ph FROM (
  SELECT a.capture_id, pow(a.i-b.i,2)+pow(a.q-b.q,2) AS g, 2*pi()*2000.0*a.n/32000.0 AS a FROM iq a JOIN iq b ON b.capture_id=a.capture_id AND b.n=a.n-1) GROUP BY 1)""", "iq"))
def _(spark, d):
    return rnd(K.symbol_timing_phase(V.iq(spark, d), ["capture_id"], "n", 2000.0, V.FS, 1024), "phase")


@query("alphabet_usage", f"""SELECT l_orderkey, n, least, round({_USE.format(c='least', n='(n::DOUBLE)', o='4.0')},6)+0.0 AS usage FROM (SELECT l_orderkey, count(*) AS n,
  least(count(*) FILTER (l_linenumber%4=0),count(*) FILTER (l_linenumber%4=1),count(*) FILTER (l_linenumber%4=2),count(*) FILTER (l_linenumber%4=3)) AS least FROM lineitem GROUP BY 1)""")
def _(spark, d):
    c = lambda j: F.count_if(F.col("l_linenumber") % 4 == j)
    g = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.least(c(0), c(1), c(2), c(3)).alias("least"))
    return g.select("l_orderkey", "n", "least", r(K.alphabet_usage(F.col("least"), F.col("n"), 4)).alias("usage"))


# Decisions
_FAM = "CASE label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.FAMILY.items()) + " END"
_HF = f"SELECT *, {_FAM} AS family FROM hyps"


def _win(src="hf", keys="candidate", join="candidates USING (candidate)"):
    on = " AND ".join(f"h.{k}=b.{k}" for k in keys.split(", "))
    sel = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f"""SELECT * EXCLUDE (fam_s, null_s, rate_s, lab_s, dig_s), coalesce(fam_s-best_score,0) AS m_fam, coalesce(null_s-best_score,'inf'::DOUBLE) AS m_null,
      CASE WHEN best_expert IN ('nrz','rrc','lsp','fsk') THEN coalesce(rate_s-best_score,0) END AS m_rate, coalesce(lab_s-best_score,'inf'::DOUBLE) AS m_label,
      coalesce(dig_s-best_score,'inf'::DOUBLE) AS m_fm_digital, CASE WHEN best_family<>'none' THEN greatest(best_residual-noise_var,0)/greatest(total_power-noise_var,1e-12) END AS unexplained FROM (
      SELECT {sel}, b.score AS best_score, b.expert AS best_expert, b.label AS best_label, b.rate AS best_rate, b.residual AS best_residual, b.usage AS best_usage, b.family AS best_family,
      min(h.score) FILTER (h.family<>b.family) AS fam_s, min(h.score) FILTER (h.expert='null') AS null_s,
      min(h.score) FILTER (h.expert IN ('nrz','rrc','lsp','fsk') AND abs(h.rate-b.rate)/b.rate>=0.05) AS rate_s,
      min(h.score) FILTER (h.label<>b.label) AS lab_s, min(h.score) FILTER (h.expert IN ('nrz','rrc','lsp','fsk','keyed')) AS dig_s
      FROM (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY score, expert, label, rate NULLS FIRST, residual, usage)=1) b JOIN {src} h ON {on} GROUP BY ALL) JOIN {join}"""


def _gate(th, src, scale="1.0"):
    lim = th if isinstance(th, dict) else {k: repr(v) for k, v in th.__dict__.items()}
    fam = (f"coalesce(best_family<>'none' AND m_fam*{scale}>={lim['m_fam']},FALSE) AND (best_label<>'FM' OR coalesce(m_fm_digital*{scale}>={lim['m_fm_digital']},FALSE))")
    lab = (f"coalesce(unexplained<={lim['unexplained_max']},FALSE) AND best_family<>'{K.UNKNOWN_CE}' AND coalesce(best_usage>={lim['min_usage']},FALSE) AND coalesce(m_label*{scale}>={lim['m_label']},FALSE)")
    return f"""SELECT *, CASE WHEN label_published THEN 'labelled' WHEN fam THEN 'unknown_family' ELSE 'abstain' END AS tier,
      label_published AND best_expert IN ('nrz','rrc','lsp','fsk') AND coalesce(m_rate*{scale}>={lim['m_rate']},FALSE) AS rate_published FROM (SELECT *, fam AND {lab} AS label_published FROM (SELECT *, {fam} AS fam FROM {src}))"""


DEC = {"hf": _HF, "win": _win(), "gated": _gate(TH, "win")}


def _dec(spark, d):
    return K.mdl_winner(V.hypotheses(spark, d), V.candidates(spark, d), ["candidate"])


def _inf(c, n=6):
    """Margins without a rival are infinite inside and NULL in results."""
    from ..functions.expr import finite_or_null
    return r(finite_or_null(F.col(c)), n).alias(c)


_MSQL = ", ".join(f"round(CASE WHEN isfinite({m}) THEN {m} END,6)+0.0 AS {m}" for m in ("m_fam", "m_null", "m_rate", "m_label", "m_fm_digital", "unexplained"))


@query("mdl_winner", sql(f"SELECT candidate, best_expert, best_label, best_family, best_rate, round(best_score,6) AS best_score, {_MSQL} FROM win", "hyps", "candidates", **DEC))
def _(spark, d):
    w = _dec(spark, d)
    return w.select("candidate", "best_expert", "best_label", "best_family", "best_rate", r(F.col("best_score")).alias("best_score"),
                    *[_inf(m) for m in ("m_fam", "m_null", "m_rate", "m_label", "m_fm_digital", "unexplained")])


@query("unexplained_share", sql("SELECT candidate, expert, label, score, round(greatest(residual-noise_var,0)/greatest(total_power-noise_var,1e-12),6)+0.0 AS share FROM hyps JOIN candidates USING (candidate)", "hyps", "candidates"))
def _(spark, d):
    j = V.hypotheses(spark, d).join(V.candidates(spark, d), "candidate")
    return j.select("candidate", "expert", "label", "score", r(K.unexplained_share(F.col("residual"), F.col("noise_var"), F.col("total_power"))).alias("share"))


@query("gate", sql("SELECT candidate, best_label, label_published, rate_published, tier FROM gated", "hyps", "candidates", **DEC))
def _(spark, d):
    return K.gate(_dec(spark, d)).select("candidate", "best_label", "label_published", "rate_published", "tier")


_TT = "CASE tier " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.TIER_TEXT.items()) + " END"


@query("tier_text", sql(f"""SELECT candidate, {_TT} AS status, CASE tier WHEN 'labelled' THEN best_family WHEN 'unknown_family' THEN CASE WHEN best_family='{K.UNKNOWN_CE}' THEN 'unknown constant-envelope family'
  ELSE '{K.UNKNOWN_TEXT}' END END AS family FROM gated""", "hyps", "candidates", **DEC))
def _(spark, d):
    g = K.gate(_dec(spark, d))
    status, fam = K.tier_text(F.col("tier"), F.col("best_family"))
    return g.select("candidate", status.alias("status"), fam.alias("family"))


@query("majority_inband_guard", sql(f"""SELECT candidate, label_published AND NOT w AS label_published, CASE WHEN w THEN 'abstain' ELSE tier END AS tier, CASE WHEN w THEN 'not reliably estimated (only '||round_even(inband*100,0)::INT||
  '% of the analysed power is inside the candidate band; the fit describes signal outside it)' ELSE {_TT} END AS status FROM (SELECT *, label_published AND inband<0.5 AS w FROM gated)""", "hyps", "candidates", **DEC))
def _(spark, d):
    return K.inband_guard(K.gate(_dec(spark, d)), "inband").select("candidate", "label_published", "tier", "status")


_FFG = f"""CASE WHEN best_family='none' THEN 'null_wins' WHEN best_family='{K.UNKNOWN_CE}' THEN 'unknown_ce' WHEN NOT coalesce(m_fam>={TH.m_fam!r},FALSE) THEN 'm_fam'
  WHEN best_label='FM' AND NOT coalesce(m_fm_digital>={TH.m_fm_digital!r},FALSE) THEN 'fm_digital' WHEN NOT coalesce(unexplained<={TH.unexplained_max!r},FALSE) THEN 'unexplained'
  WHEN NOT coalesce(best_usage>={TH.min_usage!r},FALSE) THEN 'usage' WHEN NOT coalesce(m_label>={TH.m_label!r},FALSE) THEN 'm_label' END"""


@query("first_failing_gate", sql(f"""SELECT candidate, {_FFG} AS gate, CASE WHEN candidate%9=0 THEN 'not_iq' WHEN candidate%9=1 THEN 'pulsed' WHEN candidate%9=2 THEN 'short_segment' ELSE {_FFG} END AS cause FROM win""", "hyps", "candidates", **DEC))
def _(spark, d):
    c = F.col("candidate") % 9
    st = F.when(c == 0, "not reliably estimated (requires complex IQ)").when(c == 1, "not reliably estimated (pulsed bursts not validated)") \
        .when(c == 2, "not reliably estimated (insufficient occupied samples (7 < 2000))").otherwise("not reliably estimated")
    return _dec(spark, d).select("candidate", K.first_failing_gate().alias("gate"), K.first_failing_gate(status=st).alias("cause"))


VARIANTS = [("fitted", TH, ("nrz", "rrc", "lsp", "fsk", "analog", "keyed")), ("loose", K.Thresholds(0.05, 0.0, 0.5, 0.0, 0.1, 0.05), ("nrz", "rrc", "lsp", "fsk", "analog", "keyed")),
            ("no_analog", TH, ("nrz", "rrc", "lsp", "fsk", "keyed")), ("symbols", K.Thresholds(unit="symbol"), ("nrz", "fsk"))]
_VH = " UNION ALL ".join(f"SELECT '{n}' AS variant, * FROM hf WHERE expert IN ({', '.join(repr(e) for e in (*act, 'null'))})" for n, _, act in VARIANTS)


def _vlim(f):
    return "CASE variant " + " ".join(f"WHEN '{n}' THEN {getattr(t, f)!r}" for n, t, _ in VARIANTS) + " END"


_VG = _gate({f: _vlim(f) for f in ("m_fam", "m_rate", "unexplained_max", "min_usage", "m_fm_digital", "m_label")}, "vwin", "(CASE WHEN variant='symbols' THEN fs/best_rate ELSE 1.0 END)")


@query("redecide", sql("SELECT candidate, variant, best_label, label_published, rate_published, tier FROM vg", "hyps", "candidates", hf=_HF, vh=_VH,
                       vwin=_win("vh", "candidate, variant"), vg=_VG))
def _(spark, d):
    x = K.redecide(V.hypotheses(spark, d), V.candidates(spark, d), ["candidate"], VARIANTS)
    return x.select("candidate", "variant", "best_label", "label_published", "rate_published", "tier")


_BUR = "SELECT candidate, CASE WHEN usage>=0.06 THEN CASE WHEN residual<0.06 THEN 'BPSK' ELSE label END END AS label FROM hyps"
_JOI = "SELECT candidate, CASE WHEN total_power>0.08 THEN CASE WHEN noise_var+inband>0.3 THEN 'BPSK' ELSE 'QPSK' END END AS joined FROM candidates"


@query("burst_vote", sql("""SELECT candidate, joined, agree, quiet AS joined_noconflict, CASE WHEN quiet IS NOT NULL AND agree IS NOT NULL AND quiet<>agree THEN NULL ELSE coalesce(quiet,agree) END AS joined_or_agree FROM (
  SELECT candidate, joined, CASE WHEN got>=2 AND lo=hi AND got>=n/2 THEN lo END AS agree, CASE WHEN joined IS NOT NULL AND (got=0 OR (lo=joined AND hi=joined)) THEN joined END AS quiet FROM (
  SELECT candidate, count(*) AS n, count(label) AS got, min(label) AS lo, max(label) AS hi FROM bur GROUP BY 1) LEFT JOIN joi USING (candidate))""", "hyps", "candidates", bur=_BUR, joi=_JOI))
def _(spark, d):
    h, c = V.hypotheses(spark, d), V.candidates(spark, d)
    b = h.select("candidate", F.when(F.col("usage") >= 0.06, F.when(F.col("residual") < 0.06, "BPSK").otherwise(F.col("label"))).alias("label"))
    j = c.select("candidate", F.when(F.col("total_power") > 0.08, F.when(F.col("noise_var") + F.col("inband") > 0.3, "BPSK").otherwise("QPSK")).alias("joined"))
    return K.burst_vote(b, j, ["candidate"])


@query("inband_sweep", sql("""SELECT step, count(*) AS files, count(*) FILTER (has) AS with_label, round(count(*) FILTER (has AND coalesce(okm>=step,FALSE))/nullif(count(*) FILTER (has),0),6) AS correct,
  round(count(*) FILTER (coalesce(badm>=step,FALSE))/count(*),6) AS wrong FROM (SELECT *, unnest([0.0,0.05,0.1,0.2,0.3,0.4,0.5,0.6,0.7]::DOUBLE[]) AS step FROM (
  SELECT o_orderkey AS f, o_orderkey%4<>2 AS has, okm, badm FROM orders LEFT JOIN (SELECT l_orderkey AS f, max(time_s) FILTER (truth=label) AS okm, max(time_s) FILTER (truth<>label) AS badm FROM score_rows WHERE label IS NOT NULL GROUP BY 1) ON f=o_orderkey))
  GROUP BY step""", "score_rows"))
def _(spark, d):
    s = V.score_rows(spark, d).where("label IS NOT NULL")
    lab = s.select(F.col("l_orderkey").alias("f"), (F.col("truth") == F.col("label")).alias("ok"), F.col("time_s").alias("share"))
    files = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("f"), (F.col("o_orderkey") % 4 != 2).alias("has_allowed"))
    return rnd(K.inband_sweep(lab, files, "f"), "correct", "wrong")


_BITS = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS k, (value>30)::INT AS bit, (event_type IN ('click','view'))::INT AS tb FROM events"""


def _bits(spark, d):
    e = V.table(spark, d, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2020-01-01"))
    n = PT.numbered(e, ["user_id"], day, ["ts", "event_id"], "k")
    return n.select("user_id", (F.col("k") - 1).alias("k"), (F.col("value") > 30).cast("int").alias("bit"), F.col("event_type").isin("click", "view").cast("int").alias("tb"))


@query("rate_multiple_check", sql("""SELECT user_id, changes, CASE WHEN changes<20 THEN 1 WHEN m3>=0.4*changes THEN 3 WHEN m2>=0.4*changes THEN 2 ELSE 1 END AS multiple FROM (
  SELECT user_id, count(*) AS changes, greatest(count(*) FILTER (k%3=0),count(*) FILTER (k%3=1),count(*) FILTER (k%3=2)) AS m3, greatest(count(*) FILTER (k%2=0),count(*) FILTER (k%2=1)) AS m2
  FROM (SELECT *, lag(bit) OVER (PARTITION BY user_id ORDER BY k) AS p FROM bits) WHERE p<>bit GROUP BY 1)""", bits=_BITS))
def _(spark, d):
    b = _bits(spark, d).select("user_id", "k", F.col("bit").alias("decision"))
    return K.rate_multiple_check(b, ["user_id"], share=0.4, block=4096)


@query("gap_difference_proposals")
def _(spark, d):
    return FE.gap_difference_proposals(_core_blocks(spark, d), CB, V.FS, (500.0, 12000.0))


# Symbols
_Y = "SELECT capture_id, n//800 AS blk, n%800 AS idx, i, q, i*i+q*q AS y FROM iq"
_EP = """SELECT capture_id, blk, length, CASE WHEN ph<0 THEN ph+1 ELSE ph END*8.0 AS tau, least(1.0,sqrt(c*c+s*s)/t) AS lock FROM (SELECT capture_id, blk, count(*) AS length, -atan2(-sum(ac*sin(a)),sum(ac*cos(a)))/(2*pi()) AS ph,
  sum(ac*cos(a)) AS c, sum(ac*sin(a)) AS s, sum(abs(ac)) AS t FROM (SELECT y.capture_id, y.blk, pow(y-m,2)-v AS ac, idx*2*pi()/8.0 AS a FROM y JOIN (SELECT capture_id, blk, avg(y) AS m, var_pop(y) AS v FROM y GROUP BY ALL) USING (capture_id, blk)) GROUP BY ALL)"""
_ID = """SELECT capture_id, blk, k, avg(y) AS y, avg(i) AS i, avg(q) AS q FROM (SELECT *, tau+k*8.0 AS c FROM (SELECT y.*, tau, length, unnest(range(0,floor((length-tau)/8.0)::BIGINT)) AS k FROM ep JOIN y USING (capture_id, blk)))
  WHERE c-4>=0 AND c+4<=length AND idx>=round_even(c-4,0) AND idx<round_even(c-4,0)+8 GROUP BY ALL"""
SYMS = {"y": _Y, "ep": _EP, "dump": _ID}


def _y(spark, d):
    return _local(spark, d).withColumn("y", F.col("i") * F.col("i") + F.col("q") * F.col("q"))


def _dump(spark, d):
    from ..session import written
    y = _y(spark, d)
    return written(L.integrate_and_dump(y, L.symbol_epoch(y, CB, "idx", "y", SPS), CB, "idx", ["y", "i", "q"], SPS))


@query("symbol_epoch", sql("SELECT capture_id, blk, length, round(tau,6)+0.0 AS tau, round(lock,6) AS lock FROM ep", "iq", y=_Y, ep=_EP))
def _(spark, d):
    return rnd(L.symbol_epoch(_y(spark, d), CB, "idx", "y", SPS), "tau", "lock")


@query("integrate_and_dump", sql("SELECT capture_id, blk, k, round(y,6) AS y, round(i,6)+0.0 AS i, round(q,6)+0.0 AS q FROM dump", "iq", **SYMS))
def _(spark, d):
    return rnd(_dump(spark, d), "y", "i", "q")


_FC = "SELECT capture_id, blk, greatest(0,1-avg(abs(abs(i)-m))/(max(m)+1e-30)) AS confidence FROM dump JOIN (SELECT capture_id, blk, avg(abs(i)) AS m FROM dump GROUP BY ALL) USING (capture_id, blk) GROUP BY ALL"


@query("demap_fsk", sql("""SELECT capture_id, blk, round(confidence,6) AS confidence, confidence>=0.2 AS decoded, CASE WHEN confidence>=0.2 THEN ones END AS ones FROM fc JOIN (
  SELECT capture_id, blk, count(*) FILTER (i>0) AS ones FROM dump GROUP BY ALL) USING (capture_id, blk)""", "iq", **SYMS, fc=_FC))
def _(spark, d):
    bits, c = L.demap_fsk(_dump(spark, d), CB, "i", least=0.2)
    ones = bits.groupBy(*CB).agg(F.sum("bit").alias("ones"))
    return rnd(c.join(ones, CB, "left"), "confidence")


def _ask_levels():
    ex = {"lv0": "SELECT capture_id, blk, min(y) AS lo, max(y) AS hi FROM dump GROUP BY ALL HAVING max(y)>min(y)"}
    for k in range(10):
        ex[f"lv{k + 1}"] = f"""SELECT capture_id, blk, CASE WHEN l IS NOT NULL AND h IS NOT NULL THEN l ELSE lo END AS lo, CASE WHEN l IS NOT NULL AND h IS NOT NULL THEN h ELSE hi END AS hi FROM (
          SELECT capture_id, blk, lo, hi, avg(y) FILTER (y<=(lo+hi)/2) AS l, avg(y) FILTER (y>(lo+hi)/2) AS h FROM dump JOIN lv{k} USING (capture_id, blk) GROUP BY ALL)"""
    return ex


@query("demap_ask", sql("""SELECT capture_id, blk, round(c,6) AS confidence, coalesce(c>=0.4,FALSE) AS decoded, CASE WHEN c>=0.4 THEN ones END AS ones FROM (SELECT DISTINCT capture_id, blk FROM dump) LEFT JOIN (
  SELECT capture_id, blk, greatest(0,1-avg(CASE WHEN y>(lo+hi)/2 THEN abs(y-hi) ELSE abs(y-lo) END)/((max(hi)-max(lo))/2)) AS c,
  count(*) FILTER (y>(lo+hi)/2) AS ones FROM dump JOIN lv10 USING (capture_id, blk) GROUP BY ALL) USING (capture_id, blk)""", "iq", **SYMS, **_ask_levels()))
def _(spark, d):
    bits, c = L.demap_ask(_dump(spark, d), CB, "y", least=0.4)
    return rnd(c.join(bits.groupBy(*CB).agg(F.sum("bit").alias("ones")), CB, "left"), "confidence")


_PH = """SELECT capture_id, blk, atan2(avg(4*(i*i-q*q)*i*q), avg(pow(i*i-q*q,2)-4*i*i*q*q))/4 AS phase FROM dump GROUP BY ALL"""


@query("demap_psk", sql("""SELECT capture_id, blk, count(*) AS n_symbols, round(any_value(phase),6)+0.0 AS phase, round(greatest(0,1-avg(abs(a-k4*pi()/2))/(pi()/4)),6) AS confidence, count(*) FILTER (((k4::INT%4)+4)%4=0) AS zeros FROM (
  SELECT *, round_even(a/(pi()/2),0) AS k4 FROM (SELECT capture_id, blk, phase, atan2(q*cos(phase)-i*sin(phase), i*cos(phase)+q*sin(phase)) AS a FROM dump JOIN ph USING (capture_id, blk))) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY capture_id, blk"), "iq", **SYMS, ph=_PH))
def _(spark, d):
    s, c = L.demap_psk(_dump(spark, d), CB, 4)
    z = s.groupBy(*CB).agg(F.count_if(F.col("symbol") == 0).alias("zeros"))
    return rnd(c.join(z, CB), "phase", "confidence")


@query("decode_gate", sql("""SELECT l_orderkey, line, CASE WHEN label IS NULL THEN 'not attempted (no published modulation label)' WHEN label NOT IN ('BPSK','QPSK','8PSK','FSK2','ASK2') THEN 'not attempted (no validated decoder for '||label||')'
  WHEN snr IS NULL THEN 'not attempted (unknown SNR)' WHEN snr<lim THEN 'not attempted (SNR below validated '||CASE label WHEN '8PSK' THEN '15.0' WHEN 'ASK2' THEN '8.0' ELSE '10.0' END||' dB gate)' WHEN rate IS NULL OR rate<=0 THEN 'not attempted (no reliable symbol-rate estimate)'
  WHEN 8000/rate<4 THEN 'not attempted (insufficient samples/symbol for timing recovery)' WHEN margin<CASE WHEN label LIKE '%PSK' THEN 4000 ELSE 64 END*8000/rate THEN 'not attempted (segment too short)' ELSE 'ready' END AS decode_status
  FROM (SELECT *, CASE label WHEN '8PSK' THEN 15 WHEN 'ASK2' THEN 8 ELSE 10 END AS lim FROM score_rows)""", "score_rows"))
def _(spark, d):
    s = V.score_rows(spark, d)
    return s.select("l_orderkey", "line", L.decode_gate(F.col("label"), F.col("snr"), F.col("rate"), F.lit(8000.0), F.col("margin")).alias("decode_status"))


@query("drift_lock", """SELECT capture_id, n, round(slope,9)+0.0 AS slope, round(res,6) AS residual, coalesce(abs(slope)<=5e-4 AND res<0.013,FALSE) AS locked FROM (SELECT event_type AS capture_id, count(*) AS n, regr_slope(value/1e5, event_id/1e4) AS slope,
  sqrt(greatest(regr_syy(value/1e5, event_id/1e4)-regr_slope(value/1e5, event_id/1e4)*regr_sxy(value/1e5, event_id/1e4),0)/count(*)) AS res FROM events GROUP BY 1)""")
def _(spark, d):
    e = V.table(spark, d, "events").select(F.col("event_type").alias("capture_id"), (F.col("event_id") / 1e4).alias("x"), (F.col("value") / 1e5).alias("y"))
    return L.drift_lock(e, ["capture_id"], "x", "y").select("capture_id", "n", r(F.col("slope"), 9).alias("slope"), r(F.col("residual")).alias("residual"), "locked")


@query("align_sequences", sql("""SELECT user_id, round(min(least(e,n-e)/n),6)+0.0 AS error_rate FROM (SELECT a.user_id, s, count(*) AS n, count(*) FILTER (a.bit<>b.tb) AS e FROM bits a, (SELECT unnest(range(-3,4)) AS s), bits b
  WHERE b.user_id=a.user_id AND b.k=a.k+s GROUP BY ALL) GROUP BY 1""", bits=_BITS))
def _(spark, d):
    b = _bits(spark, d)
    return rnd(L.align_sequences(b.select("user_id", "k", "bit"), b.select("user_id", "k", F.col("tb").alias("bit")), ["user_id"]), "error_rate")


@query("truncate_symbols", """SELECT vec_id, list_transform(embedding[1:20], lambda v: (v>0)::INT) AS shown, len(embedding)::INTEGER AS total, len(embedding)>20 AS truncated FROM embeddings""")
def _(spark, d):
    shown, total, cut = L.truncate_symbols(F.transform("embedding", lambda v: (v > 0).cast("int")), 20)
    return V.table(spark, d, "embeddings").select("vec_id", shown.alias("shown"), total.alias("total"), cut.alias("truncated"))


@query("symbol_text_rows", """SELECT vec_id, p//16 AS line, string_agg(CASE WHEN p%16>0 AND p%4=0 THEN ' ' ELSE '' END||s::VARCHAR, '' ORDER BY p) AS text FROM (SELECT vec_id, k AS p, (embedding[k+1]>0)::INT AS s FROM embeddings, (SELECT unnest(range(64)) AS k)) GROUP BY ALL""")
def _(spark, d):
    e = V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v > 0).cast("int")).alias("s"))
    return L.symbol_text_rows(e, ["vec_id"], "s", row=16, group=4)


@query("decode_span", """SELECT o_orderkey, CASE WHEN n<=100000 THEN s WHEN hit THEN least(s+20000,s+n-100000) END AS start_sample, CASE WHEN n<=100000 THEN s+n WHEN hit THEN least(s+20000,s+n-100000)+100000 END AS end_sample FROM (
  SELECT o_orderkey, o_custkey AS s, round_even(o_totalprice,0)::BIGINT AS n, o_orderstatus IN ('P','F') AS hit FROM orders)""")
def _(spark, d):
    o = V.table(spark, d, "orders")
    s, n = F.col("o_custkey"), F.bround("o_totalprice").cast("long")
    mk = lambda a, lab: F.struct((s + a).alias("start_sample"), (s + a + 10000).alias("end_sample"), lab.alias("label"))
    spans = F.array(mk(0, F.lit("BPSK")), mk(20000, F.when(F.col("o_orderstatus").isin("P", "F"), "QPSK")), mk(40000, F.lit("FM")))
    sp = L.decode_span(s, s + n, F.lit(100000).cast("long"), F.lit("QPSK"), spans)
    return o.select("o_orderkey", sp["start_sample"].alias("start_sample"), sp["end_sample"].alias("end_sample"))


@query("symbol_frequency", sql("""SELECT capture_id, blk, k, round(atan2(sum(im),sum(re))*32000.0/(2*pi()),4)+0.0 AS frequency_hz FROM (SELECT a.capture_id, a.blk, floor(a.idx/8.0)::BIGINT AS k, a.idx/8.0-floor(a.idx/8.0) AS fr,
  b.i*a.i+b.q*a.q AS re, b.q*a.i-b.i*a.q AS im FROM y a JOIN y b ON b.capture_id=a.capture_id AND b.blk=a.blk AND b.idx=a.idx+1) WHERE fr*8>1 AND (1-fr)*8>1 GROUP BY ALL""", "iq", y=_Y))
def _(spark, d):
    return L.symbol_frequency(_local(spark, d), CB, "idx", SPS, V.FS).withColumn("frequency_hz", r(F.col("frequency_hz"), 4))


# Calibration view: the truth of a candidate by its number (fixed values); two of them are outside the library
CAL_TRUTH = ["BPSK", "QPSK", "8PSK", "FSK2", "FM", "AM", "FSK6", "PSK16"]
CAL_UNKNOWN = ["FSK6", "PSK16"]
FIT_P, FIT_N = 0.112, 8
_CAL = f"""SELECT w.*, t, t NOT IN ('FSK6','PSK16') AND (best_label=t OR (best_label IN ('QAM','FSK','ASK') AND regexp_replace(t,'\\d+$','')=best_label)) AS ok_label,
  t='FM' AS ok_fm, candidate%3=0 AS ok_rate FROM (SELECT *, ({"[" + ", ".join(f"'{x}'" for x in CAL_TRUTH) + "]"})[candidate%8+1] AS t FROM win) w"""


def _calibration(spark, d):
    from ..operators.scoring import label_matches
    t = F.array(*[F.lit(x) for x in CAL_TRUTH])[(F.col("candidate") % 8).cast("int")]
    w = _dec(spark, d).withColumn("t", t)
    return w.withColumns({"ok_label": ~F.col("t").isin(*CAL_UNKNOWN) & label_matches(F.col("best_label"), F.col("t")),
                          "ok_fm": F.col("t") == "FM", "ok_rate": F.col("candidate") % 3 == 0})


def _picked(src: str, v: str, right: str, empty: str) -> str:
    """Largest threshold over the generations: smallest value whose tail is long and right enough, at the midpoint below it."""
    return f"""SELECT max(coalesce(t,{empty})) AS t FROM (SELECT DISTINCT gen FROM cal) LEFT JOIN (
  SELECT gen, CASE WHEN th IS NULL OR th>1e299 THEN 'inf'::DOUBLE ELSE coalesce((max(x) FILTER (x<th)+th)/2,th) END AS t FROM (
    SELECT *, min(x) FILTER (n>={FIT_N} AND k/n>={FIT_P}) OVER (PARTITION BY gen) AS th FROM (
      SELECT gen, x, sum(c) OVER w AS n, sum(r) OVER w AS k FROM (SELECT gen, round(CASE WHEN isinf({v}) THEN 1e300 ELSE {v} END,6) AS x, count(*) AS c, count(*) FILTER ({right}) AS r
        FROM {src} WHERE {v} IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY gen ORDER BY x DESC))) GROUP BY gen, th) USING (gen)"""


_DIG = "best_expert IN ('nrz','rrc','lsp','fsk')"
FIT = {"cal": _CAL,
       "s1": "SELECT * FROM cal WHERE t NOT IN ('FSK6','PSK16') AND best_family<>'none' AND best_family<>'unknown constant-envelope' AND best_usage>=0.01",
       "t1": _picked("s1", "m_fam", "ok_label", "'inf'::DOUBLE"), "s2": "SELECT * FROM s1 WHERE m_fam>=(SELECT t FROM t1)",
       "fm": "SELECT * FROM s2 WHERE best_label='FM'", "t2": _picked("fm", "m_fm_digital", "ok_fm", "0.0"),
       "s3": "SELECT * FROM s2 WHERE best_label<>'FM' OR m_fm_digital>=(SELECT t FROM t2)",
       "t3": "SELECT coalesce(quantile_cont(unexplained,0.95) FILTER (ok_label),1.0) AS t FROM s3", "s4": "SELECT * FROM s3 WHERE unexplained<=(SELECT t FROM t3)",
       "t4": _picked("s4", "m_label", "ok_label", "0.0"), "s5": "SELECT * FROM s4 WHERE m_label>=(SELECT t FROM t4)",
       "dig": f"SELECT * FROM s5 WHERE {_DIG}", "t5": _picked("dig", "m_rate", "ok_rate", "'inf'::DOUBLE")}


@query("staged_fit", sql("""SELECT 'sample' AS unit, round(CASE WHEN isfinite(t1.t) THEN t1.t END,6) AS m_fam, round(CASE WHEN isfinite(t5.t) THEN t5.t END,6) AS m_rate, round(t3.t,6) AS unexplained_max,
  round(CASE WHEN isfinite(t2.t) THEN t2.t END,6)+0.0 AS m_fm_digital, round(CASE WHEN isfinite(t4.t) THEN t4.t END,6)+0.0 AS m_label,
  (SELECT count(*) FROM s5 WHERE ok_label)+(SELECT count(*) FROM dig, t5 WHERE ok_rate AND m_rate>=t5.t) AS coverage FROM t1, t2, t3, t4, t5""", "hyps", "candidates", **DEC, **FIT))
def _(spark, d):
    from ..operators.calibration import staged_fit
    from ..session import written
    cal = written(_calibration(spark, d).where(~F.col("t").isin(*CAL_UNKNOWN)))
    f = staged_fit(cal, min_count=FIT_N, precision=FIT_P)
    return f.select("unit", *[_inf(c) for c in ("m_fam", "m_rate", "unexplained_max", "m_fm_digital", "m_label")], "coverage")


@query("unknown_wrong", sql("""SELECT count(*) AS n, count(*) FILTER (label_published) AS n_wrong, round(count(*) FILTER (label_published)/count(*),6) AS share
  FROM gated JOIN cal USING (candidate) WHERE t IN ('FSK6','PSK16')""", "hyps", "candidates", **DEC, cal=_CAL))
def _(spark, d):
    from ..operators.calibration import unknown_wrong
    x = unknown_wrong(K.gate(_calibration(spark, d)), F.col("t"), CAL_UNKNOWN)
    return x.withColumn("share", r(F.col("share")))
