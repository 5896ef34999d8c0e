"""Registered queries: region measurements, features, labels, quality flags."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions.expr import r
from ..operators import features as FE, measure as H, partitioning as PT, pulses as P, spectra as S, triage as Q
from . import views as V
from .registry import query
from .views import sql

BK = ["capture_id", "block_id"]
CB = ["capture_id", "blk"]
def _freq():
    return S.bin_frequency(V.NFFT, V.FS)

def _power():
    return F.col("i") * F.col("i") + F.col("q") * F.col("q")



def rnd(df, *cols, digits=6):
    return df.withColumns({c: r(F.col(c), digits) for c in cols})


def _psd(spark, d):
    return V.block_psd(spark, d).select(*BK, F.col("bin").cast("long").alias("bin"), "power")


def _core_blocks(spark, d):
    """800-sample stretches without guard, as arrays."""
    return S.blocks_from_chunks(V.chunks(spark, d), V.BLOCK, 0).select("capture_id", F.col("block_id").alias("blk"), "i", "q")


def _samples(spark, d):
    return V.iq(spark, d).withColumn("blk", F.floor(F.col("n") / V.BLOCK))


@query("centroid_frequency", sql("""SELECT capture_id, block_id, round(sum(e)*1e6,6) AS excess, round(sum(f*e)/nullif(sum(e),0)+coalesce(any_value(t),0.0),4)+0.0 AS center_frequency_hz
  FROM (SELECT p.capture_id, p.block_id, (bin-16)*1000.0 AS f, greatest(power-noise_floor,0) AS e, CASE WHEN block_id%2=1 THEN 1e6 END AS t FROM psd p JOIN floors f USING (capture_id, block_id)) GROUP BY ALL""", "floors"))
def _(spark, d):
    p = _psd(spark, d)
    j = p.join(S.noise_floor_median(p, BK), BK)
    c = H.centroid_frequency(j, BK, _freq(), F.col("noise_floor"), F.when(F.col("block_id") % 2 == 1, F.lit(1e6)))
    return c.select(*BK, r(F.col("excess") * 1e6).alias("excess"), r(F.col("center_frequency_hz"), 4).alias("center_frequency_hz"))


@query("snr_db", sql("""SELECT capture_id, round(o,8) AS on_power, round(CASE WHEN o>f*32000.0 THEN 10*log10((o-f*32000.0)/(f*32000.0)) END,6)+0.0 AS snr_db FROM (
  SELECT x.capture_id, avg(i*i+q*q) AS o FROM iq x JOIN loud w ON w.capture_id=x.capture_id AND x.n>=start_sample AND x.n<end_sample GROUP BY 1)
  JOIN (SELECT capture_id, median(noise_floor)*0.8 AS f FROM floors GROUP BY 1) USING (capture_id)""", "iq", "floors", loud=V.loud_sql(7)))
def _(spark, d):
    w = V.loud_windows(spark, d, 7)
    on = PT.point_in_interval(V.iq(spark, d), w, ["capture_id"], "n", "start_sample", "end_sample", 1024).groupBy("capture_id").agg(F.avg(_power()).alias("on_power"))
    f = V.frames(spark, d).groupBy(*BK).agg(F.first("floor").alias("f"))
    f = PT.quantiles(f, ["capture_id"], "f", {"m": 0.5}).select("capture_id", (F.col("m") * 0.8).alias("f"))
    x = on.join(f, "capture_id")
    return x.select("capture_id", r(F.col("on_power"), 8).alias("on_power"), r(H.snr_db(F.col("on_power"), F.col("f"), V.FS)).alias("snr_db"))


_ARR = "SELECT capture_id, block_id, list(power ORDER BY bin) AS p, count(*) AS n FROM psd GROUP BY ALL"


def _hp(src, arr, out):
    return f"""SELECT * EXCLUDE (k,half,l,rr), CASE WHEN l IS NOT NULL AND rr IS NOT NULL THEN ((rr-(half-{arr}[rr])/({arr}[rr-1]-{arr}[rr]))-(l+(half-{arr}[l])/({arr}[l+1]-{arr}[l])))*1000.0 END AS {out} FROM (
      SELECT *, list_max(list_filter(range(1,n+1), lambda j: {arr}[j]<half AND j<k)) AS l, list_min(list_filter(range(1,n+1), lambda j: {arr}[j]<half AND j>k)) AS rr FROM (
      SELECT *, list_position({arr}, list_max({arr})) AS k, list_max({arr})/2 AS half FROM {src}))"""


@query("half_power_width", sql("SELECT capture_id, block_id, round(bw,4)+0.0 AS bandwidth_3db_hz FROM hp", "psd", arr=_ARR, hp=_hp("arr", "p", "bw")))
def _(spark, d):
    a = H.region_arrays(_psd(spark, d), BK)
    return a.select(*BK, r(H.half_power_width(F.col("power"), 1000.0), 4).alias("bandwidth_3db_hz"))


def _h4():
    ex = {"arr": _ARR, "s0": "SELECT *, greatest(2,3) AS w, FALSE AS dead FROM arr"}
    for k in range(3):
        ex[f"t{k}"] = f"SELECT *, list_transform(range(n), lambda b: list_sum(p[greatest(b-w//2,0)+1 : least(b+w//2,n-1)+1])/(2*(w//2)+1)) AS sm FROM s{k}"
        ex[f"u{k}"] = _hp(f"t{k}", "sm", "bwx")
        ex[f"s{k + 1}"] = f"""SELECT capture_id, block_id, p, n, bw, bw IS NULL AS dead, coalesce(least(greatest(round_even(bw/1000.0/8,0)::BIGINT,3),greatest(3,n//4)),w) AS w FROM (
          SELECT *, CASE WHEN NOT dead THEN bwx END AS bw FROM (SELECT capture_id, block_id, p, n, w, dead, bwx FROM u{k}))"""
    return sql("SELECT capture_id, block_id, round(bw,4)+0.0 AS bandwidth_3db_hz FROM s3", "psd", **ex)


@query("smoothed_half_power_width", _h4())
def _(spark, d):
    a = H.smoothed_half_power_width(H.region_arrays(_psd(spark, d), BK), 1000.0)
    return a.select(*BK, r(F.col("bandwidth_3db_hz"), 4).alias("bandwidth_3db_hz"))


@query("occupied_99", sql("""SELECT s.capture_id, s.block_id, min(coalesce(m,32))*1000.0::DOUBLE AS bandwidth_99pct_hz FROM (SELECT a.capture_id, a.block_id, a.bin, min(b.bin+1-a.bin) AS m
  FROM c a JOIN c b ON a.capture_id=b.capture_id AND a.block_id=b.block_id AND b.bin>=a.bin AND b.cum>=a.cum-a.power+0.99*a.tot GROUP BY ALL) s GROUP BY ALL""",
  "psd", c="SELECT *, sum(power) OVER (PARTITION BY capture_id, block_id ORDER BY bin) AS cum, sum(power) OVER (PARTITION BY capture_id, block_id) AS tot FROM psd"))
def _(spark, d):
    return H.occupied_99(_psd(spark, d), BK, 1000.0)


@query("bandwidth_status", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity*4>5*l_tax*100 AND l_linenumber<>7 THEN 'unshaped-pulse-sidelobes' END AS caveat,
  CASE WHEN l_quantity<5 THEN 'not reliably estimated (insufficient occupied samples)' WHEN l_discount=0 THEN 'not reliably estimated (no resolved excess power)'
  WHEN l_linenumber=7 THEN 'partial (half-power lobe truncated by candidate band)' ELSE 'estimated' END AS status FROM lineitem""")
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    bw3 = F.when(F.col("l_linenumber") != 7, F.col("l_tax") * 100)
    return li.select("l_orderkey", "l_linenumber", H.bandwidth_caveat(bw3, F.col("l_quantity") * 4).alias("caveat"),
                     H.estimate_status(F.col("l_quantity") < 5, F.col("l_discount") != 0, bw3).alias("status"))


_PAR = """SELECT *, CASE WHEN k>1 AND k<n AND a-2*b+c<0 THEN ({first})+(k-1+least(greatest(0.5*(a-c)/(a-2*b+c),-0.5),0.5))*1000.0 END AS peak_hz FROM (
  SELECT *, ln(greatest(p[k-1],1e-30)) AS a, ln(greatest(p[k],1e-30)) AS b, ln(greatest(p[k+1],1e-30)) AS c FROM (SELECT *, list_position(p, list_max(p)) AS k FROM {src}))"""


@query("parabolic_peak", sql("SELECT capture_id, block_id, round(peak_hz,4)+0.0 AS peak_hz FROM pk", "psd", arr=_ARR, pk=_PAR.format(first="-16000.0", src="arr")))
def _(spark, d):
    a = H.region_arrays(_psd(spark, d), BK)
    return a.select(*BK, r(H.parabolic_peak(F.col("power"), F.lit(-16000.0), 1000.0), 4).alias("peak_hz"))


@query("lowest_near_peak", sql("""SELECT capture_id, block_id, min(bin*1000.0::DOUBLE) AS symbol_rate_hz FROM (SELECT *, max(power) OVER (PARTITION BY capture_id, block_id) AS t FROM psd WHERE bin>=4)
  WHERE power>=t/pow(10,0.3) GROUP BY ALL""", "psd"))
def _(spark, d):
    return H.lowest_near_peak(_psd(spark, d), BK, F.col("bin") * 1000.0)


@query("top_lines", sql("""SELECT capture_id, block_id, row_number() OVER (PARTITION BY capture_id, block_id ORDER BY power DESC, bin) AS rank,
  round((bin-16)*1000.0+least(greatest(0.5*(a-c)/(a-2*b+c),-0.5),0.5)*1000.0,4)+0.0 AS frequency_hz, round(power*1e6,6) AS power FROM (
  SELECT *, ln(greatest(l,1e-30)) AS a, ln(greatest(power,1e-30)) AS b, ln(greatest(rr,1e-30)) AS c FROM (SELECT *, lag(power) OVER w AS l, lead(power) OVER w AS rr FROM psd
  WINDOW w AS (PARTITION BY capture_id, block_id ORDER BY bin)) WHERE power>l AND power>rr)
  QUALIFY row_number() OVER (PARTITION BY capture_id, block_id ORDER BY power DESC, bin)<=3""", "psd"))
def _(spark, d):
    t = H.top_lines(_psd(spark, d), BK, lambda b: (b - 16) * F.lit(1000.0), 3, 1000.0)
    return t.select(*BK, F.col("rank").cast("long").alias("rank"), r(F.col("frequency_hz"), 4).alias("frequency_hz"), r(F.col("power") * 1e6).alias("power"))


_PROPS = """SELECT candidate, list(rate ORDER BY score, expert, label, residual, usage, rate) AS rates FROM (SELECT * FROM hyps WHERE rate IS NOT NULL) GROUP BY 1"""


@query("dedupe_tolerance", sql("""SELECT candidate, list_reduce(list_transform(list_filter(rates, lambda x: x>=300 AND x<=4800), lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: abs(x[1]-q)/q<0.3))>0
  THEN acc ELSE list_concat(acc,x) END, []::DOUBLE[]) AS kept FROM props""", "hyps", props=_PROPS))
def _(spark, d):
    # the hypotheses of one candidate, best first
    w = W.partitionBy("candidate").orderBy("score", "expert", "label", "residual", "usage", "rate")
    h = V.hypotheses(spark, d).where("rate IS NOT NULL").withColumn("rn", F.row_number().over(w))
    g = h.groupBy("candidate").agg(F.array_sort(F.collect_list(F.struct("rn", "rate"))).alias("a"))
    return g.select("candidate", H.dedupe_tolerance(F.transform("a", lambda s: s["rate"]), 300.0, 4800.0, 0.3).alias("kept"))


@query("inband_share", sql("SELECT capture_id, block_id, round(sum(power) FILTER (abs((bin-16)*1000.0)<=4000)/sum(power),6) AS inband_share FROM psd GROUP BY ALL", "psd"))
def _(spark, d):
    return rnd(H.inband_share(_psd(spark, d), BK, _freq(), 8000.0), "inband_share")


@query("occupied_centroid", sql("""SELECT capture_id, block_id, round(coalesce(sum(f*e)/nullif(sum(e),0),0),4)+0.0 AS centroid_hz, round(max(fl)*32000.0,6) AS noise_power FROM (
  SELECT p.*, (bin-16)*1000.0 AS f, fl, CASE WHEN power>2*fl THEN power-fl ELSE 0 END AS e FROM psd p JOIN (SELECT capture_id, block_id, quantile_cont(power,0.2) AS fl FROM psd GROUP BY ALL) USING (capture_id, block_id)) GROUP BY ALL""", "psd"))
def _(spark, d):
    c = H.occupied_centroid(_psd(spark, d), BK, _freq(), V.FS)
    return c.select(*BK, r(F.col("centroid_hz"), 4).alias("centroid_hz"), r(F.col("noise_power")).alias("noise_power"))


@query("model_snr", """SELECT l_orderkey, l_linenumber, round(CASE WHEN m IS NOT NULL AND (s IS NULL OR m>s) THEN m ELSE s END,6)+0.0 AS snr_db,
  CASE WHEN m IS NOT NULL AND (s IS NULL OR m>s) THEN 'model residual (published verify rebuild)' WHEN s IS NOT NULL THEN 'spectral (occupied power vs percentile noise floor)' END AS method FROM (
  SELECT *, CASE WHEN l_tax*l_linenumber>0 AND l_discount+0.02-l_tax>0 THEN 10*log10((l_discount+0.02-l_tax)/(l_tax*l_linenumber)) END AS m, CASE WHEN l_linenumber<>4 THEN l_quantity/5 END AS s FROM lineitem)""")
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    m = H.model_snr(F.col("l_tax"), F.col("l_linenumber"), F.col("l_discount") + 0.02)
    snr, how = H.larger_snr(F.when(F.col("l_linenumber") != 4, F.col("l_quantity") / 5), m)
    return li.select("l_orderkey", "l_linenumber", r(snr).alias("snr_db"), how.alias("method"))


@query("choose_decimation", """SELECT o_orderkey, decim, CASE WHEN n//decim<2000 THEN 'insufficient occupied samples ('||n||' < 2000)' END AS reason FROM (
  SELECT *, greatest(1,least(greatest(1,floor(1e6/(4*greatest(o_totalprice%50000.0::DOUBLE,1e6/1024)))),n//2000))::BIGINT AS decim FROM (SELECT *, (o_totalprice/10)::BIGINT AS n FROM orders))""")
def _(spark, d):
    o = V.table(spark, d, "orders").withColumn("n", F.bround(F.col("o_totalprice") / 10).cast("long"))
    dec, why = H.choose_decimation(F.col("n"), F.col("o_totalprice") % 50000.0, F.lit(1e6))
    return o.select("o_orderkey", dec.alias("decim"), why.alias("reason"))


@query("m2m4_snr", sql("""SELECT capture_id, blk, round(least(greatest(10*log10(s/greatest(m2-s,1e-12)),-10),30),6)+0.0 AS snr_db FROM (SELECT *, sqrt(greatest(2*m2*m2-m4,1e-12)) AS s FROM (
  SELECT capture_id, n//800 AS blk, avg(i*i+q*q) AS m2, avg((i*i+q*q)*(i*i+q*q)) AS m4 FROM iq GROUP BY ALL))""", "iq"))
def _(spark, d):
    return rnd(H.m2m4_snr(_samples(spark, d), CB), "snr_db")


_V = "SELECT candidate, rate FROM hyps WHERE rate IS NOT NULL"
_SUP = "SELECT a.candidate, a.rate, count(*) AS sup FROM (SELECT DISTINCT candidate, rate FROM votes) a JOIN votes b ON a.candidate=b.candidate AND abs(b.rate-a.rate)/a.rate<0.047 GROUP BY ALL"


@query("consensus_rate", sql("""SELECT b.candidate, b.sup AS support, b.rate AS best, round(median(v.rate),6) AS rate_hz, round(b.sup/(SELECT count(*) FROM votes z WHERE z.candidate=b.candidate),6) AS share
  FROM (SELECT * FROM sup QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY sup DESC, rate)=1) b JOIN votes v ON v.candidate=b.candidate AND abs(v.rate-b.rate)/b.rate<0.047 GROUP BY ALL""", "hyps", votes=_V, sup=_SUP))
def _(spark, d):
    v = V.hypotheses(spark, d).where("rate IS NOT NULL").select("candidate", "rate")
    return rnd(H.consensus_rate(v, ["candidate"], "rate", 0.047), "rate_hz", "share")


# Features
@query("envelope_variation", sql("""SELECT capture_id, blk, round(v,6) AS envelope_variation, CASE WHEN v<0.3 THEN 'constant-envelope' ELSE 'varying-envelope' END AS modulation_family,
  round(least(1,abs(v-0.3)/0.3),6) AS modulation_confidence FROM (SELECT capture_id, n//800 AS blk, stddev_pop(sqrt(i*i+q*q))/avg(sqrt(i*i+q*q)) AS v FROM iq GROUP BY ALL)""", "iq"))
def _(spark, d):
    return rnd(FE.envelope_variation(_samples(spark, d), CB), "envelope_variation", "modulation_confidence")


_PC = """SELECT capture_id, blk, m AS "order", sqrt(pow(avg(cos(m*ph)),2)+pow(avg(sin(m*ph)),2)) AS c FROM (SELECT capture_id, n//800 AS blk, atan2(q,i) AS ph, unnest([2,4,8]) AS m FROM iq) GROUP BY ALL"""


@query("phase_concentration", sql("""SELECT capture_id, blk, "order", round(c,6) AS concentration, round(sp,6) AS spread_rad, CASE WHEN sp<lim THEN lab END AS label, round(CASE WHEN sp<lim THEN 1-sp/lim END,6) AS confidence FROM (
  SELECT *, sqrt(greatest(0,-2*ln(least(1,c)))) AS sp, CASE "order" WHEN 8 THEN 1.4 ELSE 0.8 END::DOUBLE AS lim, CASE "order" WHEN 2 THEN 'bpsk' WHEN 4 THEN 'qpsk' ELSE '8psk' END AS lab FROM pc)""", "iq", pc=_PC))
def _(spark, d):
    return rnd(FE.phase_concentration(_samples(spark, d), CB), "concentration", "spread_rad", "confidence")


def _dft(src, nf=49, real=False):
    """Average 32-point spectrum, hop 16, of local samples (capture_id, blk, k, i, q)."""
    bins, off, two = ("range(17)", 0, "*CASE WHEN bin BETWEEN 1 AND 15 THEN 2 ELSE 1 END") if real else ("range(32)", 16, "")
    return f"""SELECT capture_id, blk, bin, pw{two} AS power FROM (SELECT capture_id, blk, bin, avg(p) AS pw FROM (SELECT capture_id, blk, f, bin, (pow(sum(w*(i*cos(a)+q*sin(a))),2)+pow(sum(w*(q*cos(a)-i*sin(a))),2))/(32000.0*12) AS p FROM (
      SELECT capture_id, blk, f, bin, i, q, 0.5-0.5*cos(2*pi()*(k-16*f)/32) AS w, 2*pi()*(bin-{off})*(k-16*f)/32 AS a FROM {src}, (SELECT unnest(range({nf})) AS f), (SELECT unnest({bins}) AS bin)
      WHERE k-16*f BETWEEN 0 AND 31) GROUP BY ALL) GROUP BY ALL)"""


_X1 = "SELECT capture_id, n//800 AS blk, n%800 AS k, i, q FROM iq"


def _sq(src):
    return f"SELECT capture_id, blk, k, i*i-q*q AS i, 2*i*q AS q FROM {src}"


POWERS = {"x1": _X1, "x2": _sq("x1"), "x4": _sq("x2"), "x8": _sq("x4"), "p1": _dft("x1"), "p2": _dft("x2"), "p4": _dft("x4"), "p8": _dft("x8")}
_TONES = " UNION ALL ".join(f"SELECT {m} AS m, capture_id, blk, list(power ORDER BY bin) AS p, count(*) AS n, max(power)/greatest(median(power),1e-30) AS sharp FROM p{m} GROUP BY ALL" for m in (2, 4, 8))


@query("raised_tone", sql("""SELECT capture_id, blk, m AS "order", round(sharp,6) AS sharpness, round(peak_hz/m,4)+0.0 AS residual_hz FROM pk WHERE peak_hz IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY capture_id, blk ORDER BY sharp DESC, m DESC)=1""", "iq", **POWERS, tones=_TONES, pk=_PAR.format(first="-16000.0", src="tones")))
def _(spark, d):
    t = FE.raised_tone(_core_blocks(spark, d), CB, V.FS, V.NFFT, length=V.BLOCK)
    return t.select(*CB, "order", r(F.col("sharpness")).alias("sharpness"), r(F.col("residual_hz"), 4).alias("residual_hz"))


_MAGS = "SELECT capture_id, n//800 AS blk, sqrt(i*i+q*q) AS v, i, q FROM iq"


def _clusters(rounds, ks="[2,3,4]"):
    ex = {"mags": _MAGS, "c0": f"""SELECT capture_id, blk, k, list_transform(range(k), lambda j: a+(b-a)*(j+0.5)/k) AS lv FROM (SELECT *, unnest({ks}) AS k FROM (SELECT capture_id, blk, min(v) AS a, max(v) AS b FROM mags GROUP BY ALL))"""}
    for x in range(rounds):
        ex[f"a{x}"] = f"""SELECT capture_id, blk, k, lv, v, i, q, len(list_filter(range(1,len(lv)), lambda j: v>(lv[j]+lv[j+1])/2)) AS c FROM mags JOIN c{x} USING (capture_id, blk)"""
        ex[f"c{x + 1}"] = f"SELECT capture_id, blk, k, list(m ORDER BY m) AS lv FROM (SELECT capture_id, blk, k, c, avg(v) AS m FROM a{x} GROUP BY ALL) GROUP BY ALL"
    ex["asg"] = f"SELECT capture_id, blk, k, lv, v, i, q, len(list_filter(range(1,len(lv)), lambda j: v>(lv[j]+lv[j+1])/2)) AS c FROM mags JOIN c{rounds} USING (capture_id, blk)"
    ex["kbest"] = """SELECT * FROM (SELECT capture_id, blk, k, lv, list_min(list_transform(range(1,len(lv)), lambda j: lv[j+1]-lv[j]))/max(s) AS score FROM (
      SELECT capture_id, blk, k, lv, c, stddev_pop(v) AS s, count(*) AS n FROM asg GROUP BY ALL) GROUP BY capture_id, blk, k, lv HAVING count(*)=k AND max(s)>0 AND sum(n)>=8*k)
      QUALIFY row_number() OVER (PARTITION BY capture_id, blk ORDER BY score DESC, k)=1"""
    return ex


CLUSTERS = _clusters(3)


def _kbest(spark, d):
    m = _samples(spark, d).withColumn("v", F.hypot("i", "q"))
    return m, FE.level_clusters(m, CB, "v", rounds=3)


@query("level_clusters", sql("SELECT capture_id, blk, k, round(score,6) AS score, list_transform(lv, lambda x: round(x,6)) AS levels FROM kbest", "iq", **CLUSTERS))
def _(spark, d):
    c = _kbest(spark, d)[1]
    return c.select(*CB, "k", r(F.col("score")).alias("score"), F.transform("levels", lambda x: F.round(x, 6)).alias("levels"))


@query("ask_qam_label", sql("""SELECT capture_id, blk, CASE WHEN score*1.5>=3 THEN CASE WHEN cc>=0.55 THEN 'ask' ELSE 'qam' END END AS label,
  round(CASE WHEN score*1.5>=3 THEN least(1,(score*1.5-3)/3)*CASE WHEN cc>=0.55 THEN 1 ELSE 0.5 END END,6)+0.0 AS confidence, CASE WHEN score*2>=5.5 THEN 'fsk' END AS fsk, round(cc,6) AS concentration FROM kbest
  JOIN (SELECT capture_id, blk, sqrt(pow(avg(cos(atan2(q,i))),2)+pow(avg(sin(atan2(q,i))),2)) AS cc FROM asg JOIN (SELECT capture_id, blk, k FROM kbest) USING (capture_id, blk, k) WHERE c=k-1 GROUP BY ALL) USING (capture_id, blk)""", "iq", **CLUSTERS))
def _(spark, d):
    m, c = _kbest(spark, d)
    from ..session import written
    c = written(c)
    top = FE.top_level_rows(m, c, CB, "v")
    pc = FE.phase_concentration(top, CB, orders=(1,)).select(*CB, "concentration")
    lab, conf = FE.ask_qam_label(F.col("score") * 1.5, F.col("concentration"))
    return c.join(pc, CB).select(*CB, lab.alias("label"), r(conf).alias("confidence"), FE.fsk_label(F.col("score") * 2)[0].alias("fsk"),
                                 r(F.col("concentration")).alias("concentration"))


@query("ring_uniformity", sql("""SELECT capture_id, blk, count(*) AS n_outer, round(sqrt(pow(avg(cos(4*atan2(q,i))),2)+pow(avg(sin(4*atan2(q,i))),2)),6) AS concentration,
  CASE WHEN count(*)>=16 THEN sqrt(pow(avg(cos(4*atan2(q,i))),2)+pow(avg(sin(4*atan2(q,i))),2))<0.05 END AS is_apsk FROM asg JOIN (SELECT capture_id, blk, k FROM kbest) USING (capture_id, blk, k) WHERE c=k-1 GROUP BY ALL""", "iq", **CLUSTERS))
def _(spark, d):
    m, c = _kbest(spark, d)
    return rnd(FE.ring_uniformity(FE.top_level_rows(m, c, CB, "v"), CB), "concentration")


_DM = "SELECT capture_id, blk, k-1 AS k, pow(i-lag(i) OVER w,2) AS i, 0.0 AS q FROM x1 WINDOW w AS (PARTITION BY capture_id, blk ORDER BY k) QUALIFY k>0"


@query("symbol_rate_delay_multiply", sql("""SELECT capture_id, blk, min(bin*1000.0::DOUBLE) AS symbol_rate_hz FROM (SELECT *, max(power) OVER (PARTITION BY capture_id, blk) AS t FROM pd WHERE bin>=4)
  WHERE power>=t/pow(10,0.3) GROUP BY ALL""", "iq", x1=_X1, dm=_DM, pd=_dft("dm", 48, True)))
def _(spark, d):
    s = FE.block_spectra(FE.delay_multiply(_core_blocks(spark, d)), CB, V.FS, V.NFFT, real=True, length=V.BLOCK - 1)
    z = s.select(*CB, F.posexplode("power").alias("bin", "power"))
    return H.lowest_near_peak(z, CB, F.col("bin") * 1000.0)


_RFI = """SELECT a.capture_id, a.n//800 AS blk, atan2(a.q*b.i-a.i*b.q, a.i*b.i+a.q*b.q) AS fi FROM iq a JOIN iq b ON b.capture_id=a.capture_id AND b.n=a.n-1"""


@query("router_features", sql("""SELECT capture_id, blk, round(env,6) AS env, round(c,6) AS carrier, round(m2,6) AS m2, round(m4,6) AS m4, round(k4/(k2*k2+1e-12),6) AS if_kurt, round(sqrt(k2),6) AS if_std FROM (
  SELECT capture_id, blk, stddev_pop(sqrt(i*i+q*q))/avg(sqrt(i*i+q*q)) AS env FROM x1 GROUP BY ALL) JOIN (SELECT capture_id, blk, 10*log10(max(power)/median(power)) AS c FROM p1 GROUP BY ALL) USING (capture_id, blk)
  JOIN (SELECT capture_id, blk, 5*log10(max(power)/median(power)) AS m2 FROM p2 GROUP BY ALL) USING (capture_id, blk) JOIN (SELECT capture_id, blk, 5*log10(max(power)/median(power)) AS m4 FROM p4 GROUP BY ALL) USING (capture_id, blk)
  JOIN (SELECT capture_id, blk, avg(pow(fi-m,4)) AS k4, avg(pow(fi-m,2)) AS k2 FROM rfi JOIN (SELECT capture_id, blk, avg(fi) AS m FROM rfi GROUP BY ALL) USING (capture_id, blk) GROUP BY ALL) USING (capture_id, blk)""",
  "iq", **{k: POWERS[k] for k in ("x1", "x2", "x4", "p1", "p2", "p4")}, rfi=_RFI))
def _(spark, d):
    b = _core_blocks(spark, d)
    fi = P.instantaneous_frequency(V.iq(spark, d), ["capture_id"], V.FS, 1024).withColumn("fi", F.col("fi") / (V.FS / 6.283185307179586))
    fi = fi.withColumn("blk", F.floor(F.col("n") / V.BLOCK))
    sp = {"carrier": (FE.block_spectra(b, CB, V.FS, V.NFFT, length=V.BLOCK), 10.0), "m2": (FE.block_spectra(FE.raise_arrays(b, 2), CB, V.FS, V.NFFT, length=V.BLOCK), 5.0),
          "m4": (FE.block_spectra(FE.raise_arrays(b, 4), CB, V.FS, V.NFFT, length=V.BLOCK), 5.0)}
    f = FE.router_features(_samples(spark, d), fi, sp, CB)
    return rnd(f, "env", "carrier", "m2", "m4", "if_kurt", "if_std")


_KAP = """SELECT *, y4/(y2*y2) AS kappa, CASE WHEN y2-nz>0 AND y4-4*(y2-nz)*nz-2*nz*nz>0 THEN (y4-4*(y2-nz)*nz-2*nz*nz)/((y2-nz)*(y2-nz)) END AS den FROM (
  SELECT *, y2/(1+pow(10,1.5)) AS nz FROM (SELECT capture_id, n//800 AS blk, avg(i*i+q*q) AS y2, avg((i*i+q*q)*(i*i+q*q)) AS y4 FROM iq GROUP BY ALL))"""


@query("kappa", sql("SELECT capture_id, blk, round(kappa,6) AS kappa, round(den,6) AS kappa_denoised FROM kap", "iq", kap=_KAP))
def _(spark, d):
    return rnd(FE.kappa(_samples(spark, d), CB, F.lit(15.0)), "kappa", "kappa_denoised")


@query("nearest_reference", """SELECT l_orderkey, l_linenumber, CASE WHEN g>=0.02 THEN m END AS "order", round(g,6) AS gap FROM (SELECT l_orderkey, l_linenumber, d[1].m AS m, d[2].d-d[1].d AS g FROM (
  SELECT *, list_sort([{'d': abs(1.3197-x), 'm': 16}, {'d': abs(1.3815-x), 'm': 64}, {'d': abs(1.3952-x), 'm': 256}]) AS d FROM (SELECT *, 1.3+l_extendedprice/1e6 AS x FROM lineitem)))""")
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    o, g = FE.nearest_reference(1.3 + F.col("l_extendedprice") / 1e6)
    return li.select("l_orderkey", "l_linenumber", o.alias("order"), r(g).alias("gap"))


@query("label_ladder", """SELECT l_orderkey, l_linenumber, coalesce(a,b,c) AS label, CASE WHEN a IS NOT NULL THEN 'phase' WHEN b IS NOT NULL THEN 'frequency' WHEN c IS NOT NULL THEN 'envelope' END AS provenance FROM (
  SELECT *, CASE WHEN l_tax<0.02 THEN 'bpsk' END AS a, CASE WHEN l_discount>0.07 THEN 'fsk' END AS b, CASE WHEN l_quantity>30 THEN CASE WHEN l_linestatus='O' THEN 'ask' ELSE 'qam' END END AS c FROM lineitem)""")
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    lab, why = FE.label_ladder([("phase", F.when(F.col("l_tax") < 0.02, F.lit("bpsk"))), ("frequency", F.when(F.col("l_discount") > 0.07, F.lit("fsk"))),
                                ("envelope", F.when(F.col("l_quantity") > 30, F.when(F.col("l_linestatus") == "O", "ask").otherwise("qam")))])
    return li.select("l_orderkey", "l_linenumber", lab.alias("label"), why.alias("provenance"))


# the Hilbert twin of an even number of samples as a circular sum over odd distances
_TWIN = """SELECT a.capture_id, a.n, a.i, a.q, sum(b.v*2/total/tan(pi()*(a.n-b.n)/total)) AS h FROM iqv a JOIN iqv b ON a.capture_id=b.capture_id AND (a.n-b.n)%2<>0
  JOIN caps c ON c.capture_id=a.capture_id GROUP BY ALL"""


@query("iq_or_audio", sql("""SELECT capture_id, round(c,6)+0.0 AS correlation, round(qd,6) AS quadrature, round(least(va,vb)/greatest(va,vb),6) AS balance,
  CASE WHEN least(va,vb)>=1e-15 AND qd>0.9 AND abs(c)<0.2 AND least(va,vb)/greatest(va,vb)>0.5 THEN 'iq_pair_evidence' ELSE 'ambiguous' END AS result FROM (
  SELECT capture_id, var_pop(i) AS va, var_pop(q) AS vb, corr(i,q) AS c, abs(corr(h,q)) AS qd FROM twin GROUP BY 1)""", "iq", "caps",
  iqv="SELECT capture_id, n, i, q, i-avg(i) OVER (PARTITION BY capture_id) AS v FROM iq", twin=_TWIN))
def _(spark, d):
    # the twin is made in guarded blocks of the whole recording; the sums over core samples combine
    b = S.blocks_from_chunks(V.chunks(spark, d), 131_072, 4_096)
    h = FE.hilbert_blocks(b.select("capture_id", "lft", "core_start", "core_end", "i", "q"))
    z = h.select("capture_id", "lft", "core_start", "core_end", F.posexplode(F.arrays_zip("i", "q", "h")).alias("p", "s"))
    z = z.where((F.col("lft") + F.col("p") >= F.col("core_start")) & (F.col("lft") + F.col("p") < F.col("core_end")))
    p = z.select("capture_id", F.col("s.i").alias("a"), F.col("s.q").alias("b"), F.col("s.h").alias("h"))
    return rnd(FE.iq_or_audio(p, ["capture_id"]), "correlation", "quadrature", "balance")


# Quality flags
_BW = "SELECT capture_id, bin, 10*log10(greatest(sum(power*(core_end-core_start))/sum(core_end-core_start),1e-30)) AS pdb FROM psd GROUP BY ALL"
_DC = """SELECT capture_id, max(pdb) FILTER (near)-median(pdb) FILTER (NOT near) AS e FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY abs((bin-16)*1000.0), bin)<=3 AS near FROM bw) GROUP BY 1"""
_FN = "SELECT capture_id, quantile_cont(pdb,0.75)-quantile_cont(pdb,0.25) AS s FROM bw GROUP BY 1"
_CL = """SELECT capture_id, avg((m>0.98*CASE WHEN capture_id%2=0 THEN 1.0 ELSE pk END)::INT) AS sh, max(pk) AS pk FROM (SELECT capture_id, sqrt(i*i+q*q) AS m, max(sqrt(i*i+q*q)) OVER (PARTITION BY capture_id) AS pk FROM iq) GROUP BY 1"""


def _cpsd(spark, d):
    return S.block_weighted_psd(V.block_psd(spark, d), F.col("core_end") - F.col("core_start"))


def _typed(spark, d):
    return V.iq(spark, d).withColumn("datatype", F.when(F.col("capture_id") % 2 == 0, "ci16_le").otherwise("cf32_le"))


@query("dc_spike", sql("SELECT capture_id, round(e,6)+0.0 AS dc_excess_db, e>15 AS dc_spike FROM dc", "psd", bw=_BW, dc=_DC))
def _(spark, d):
    return rnd(Q.dc_spike(_cpsd(spark, d), ["capture_id"], _freq()), "dc_excess_db")


@query("floor_nonflat", sql("SELECT capture_id, round(s,6) AS spread_db, s>12 AS floor_nonflat FROM fn", "psd", bw=_BW, fn=_FN))
def _(spark, d):
    return rnd(Q.floor_nonflat(_cpsd(spark, d), ["capture_id"]), "spread_db")


@query("clipping", sql("SELECT capture_id, round(sh,8)+0.0 AS share_near_full_scale, round(pk,6) AS peak, sh>0.001 AND pk>0 AS clipping FROM cl", "iq", cl=_CL))
def _(spark, d):
    c = Q.clipping(_typed(spark, d), ["capture_id"], "datatype")
    return c.select("capture_id", r(F.col("share_near_full_scale"), 8).alias("share_near_full_scale"), r(F.col("peak")).alias("peak"), "clipping")


@query("triage_report", sql("""SELECT capture_id, e>15 AS dc_spike, s>12 AS floor_nonflat, sh>0.001 AND pk>0 AS clipping, NULL::VARCHAR AS error FROM dc JOIN fn USING (capture_id) JOIN cl USING (capture_id)
  UNION ALL SELECT 1000000+doc_id, NULL, NULL, NULL, 'unreadable capture' FROM documents WHERE n_chars<40""", "psd", "iq", bw=_BW, dc=_DC, fn=_FN, cl=_CL))
def _(spark, d):
    err = V.table(spark, d, "documents").where("n_chars < 40").select((F.col("doc_id") + 1000000).alias("capture_id"), F.lit("unreadable capture").alias("error"))
    return Q.triage_report(_cpsd(spark, d), _typed(spark, d), ["capture_id"], _freq(), "datatype", err)
