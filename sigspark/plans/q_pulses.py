"""Registered queries: isolation, envelope, pulses, packets, bursts, tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import partitioning as PT, pulses as P, tracks as TR
from ..session import written
from . import views as V
from .registry import query
from .views import ORDERED_SQL, WALK_SQL, recursive, sql

KEY = ["capture_id"]
def _power():
    return F.col("i") * F.col("i") + F.col("q") * F.col("q")

# the view band that gets isolated
LO, HI = 1000.0, 5000.0
NOISE = 1.0
W_TICKS = 3

_TAPS = """SELECT m, h/sum(h) OVER () AS h FROM (SELECT m, (CASE WHEN m=128 THEN c ELSE sin(pi()*c*(m-128))/(pi()*(m-128)) END)
  *(0.54-0.46*cos(2*pi()*m/256)) AS h FROM (SELECT unnest(range(257)) AS m, 2000.0/16000.0 AS c))"""
_MIXED = """SELECT capture_id, n, i*cos(a)+q*sin(a) AS i, q*cos(a)-i*sin(a) AS q FROM (SELECT *, 2*pi()*3000.0*n/32000.0 AS a FROM iq)"""
_ISO = """SELECT x.capture_id, x.n, sum(y.i*h) AS i, sum(y.q*h) AS q FROM (SELECT capture_id, n, n+m-128 AS yn, h FROM iq, taps) x
  JOIN mixed y ON y.capture_id=x.capture_id AND y.n=x.yn GROUP BY ALL"""
_LEVEL = """SELECT capture_id, high, low, greatest(4.0,low+0.45*(high-low)) AS threshold FROM (SELECT capture_id, quantile_cont(power,0.1) AS low FROM ticks GROUP BY 1)
  JOIN (SELECT capture_id, median(power) AS high FROM (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY power DESC)<=3) GROUP BY 1) USING (capture_id)"""
_ON = """SELECT capture_id, min(n) AS s, max(n)+1 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY n) AS g FROM (
  SELECT t.capture_id, n, CASE WHEN n-lag(n) OVER (PARTITION BY t.capture_id ORDER BY n)<=3 THEN 0 ELSE 1 END AS new
  FROM ticks t JOIN level l USING (capture_id) WHERE power>threshold)) GROUP BY capture_id, g"""
_PSUM = """SELECT l.*, n_samples, coalesce(on_samples,0) AS on_samples, coalesce(n_windows,0) AS n_windows FROM level l
  JOIN (SELECT capture_id, count(*) AS n_samples FROM ticks GROUP BY 1) USING (capture_id)
  LEFT JOIN (SELECT capture_id, sum(e-s) AS on_samples, count(*) FILTER (e-s>=6) AS n_windows FROM onruns GROUP BY 1) USING (capture_id)"""
_PWIN = """SELECT o.capture_id, s AS start_sample, e AS end_sample FROM onruns o JOIN psum p USING (capture_id)
  WHERE e-s>=6 AND n_windows>0 AND high/greatest(low,1.0)>8 AND on_samples/n_samples>0 AND on_samples/n_samples<0.75"""
PULSE = {"level": _LEVEL, "onruns": _ON, "psum": _PSUM, "pwin": _PWIN}


@query("mix_to_baseband", sql("SELECT capture_id, n, round(i,6)+0.0 AS i, round(q,6)+0.0 AS q FROM mixed", "iq", mixed=_MIXED))
def _(spark, d):
    return P.mix_to_baseband(V.iq(spark, d), 3000.0, V.FS).withColumns({c: r(F.col(c)) for c in "iq"})


def _isolated(spark, d):
    b = V.blocks(spark, d).withColumns({"lower_hz": F.lit(LO), "upper_hz": F.lit(HI)})
    from ..operators.spectra import samples_from_chunks
    return samples_from_chunks(P.isolate_band(b, V.FS))


@query("isolate_band", sql("SELECT capture_id, n, round(i,6)+0.0 AS i, round(q,6)+0.0 AS q FROM iso", "iq", taps=_TAPS, mixed=_MIXED, iso=_ISO))
def _(spark, d):
    return _isolated(spark, d).withColumns({c: r(F.col(c)) for c in "iq"})


@query("envelope_power", sql("""SELECT x.capture_id, x.n, round(avg(y.i*y.i+y.q*y.q),6) AS envelope FROM (SELECT capture_id, n, total,
  unnest(range(-16,16)) AS o FROM iq JOIN caps USING (capture_id)) x JOIN iq y ON y.capture_id=x.capture_id
  AND y.n=CASE WHEN x.n+o<0 THEN -(x.n+o)-1 WHEN x.n+o>=total THEN 2*total-1-(x.n+o) ELSE x.n+o END GROUP BY ALL""", "iq", "caps"))
def _(spark, d):
    s = V.iq(spark, d).join(V.catalog(spark, d), KEY)
    e = P.moving_mean(s, KEY, "n", _power(), P.envelope_window(V.FS), "n_samples", block=1024)
    return e.select("capture_id", "n", r(F.col("envelope")).alias("envelope"))


def _level(spark, d):
    t = V.ticks(spark, d)
    return t, P.on_level(t, KEY, "power", W_TICKS, NOISE)


@query("on_level_threshold", sql("SELECT capture_id, round(high,6) AS high, round(low,6)+0.0 AS low, round(threshold,6) AS threshold FROM level",
                                 "ticks", level=_LEVEL))
def _(spark, d):
    return _level(spark, d)[1].select("capture_id", *[r(F.col(c)).alias(c) for c in ("high", "low", "threshold")])


@query("pulse_summary", sql("""SELECT capture_id, n_samples, on_samples::BIGINT AS on_samples, n_windows, round(on_samples/n_samples,6) AS duty,
  round(high/greatest(low,1.0),6) AS contrast, n_windows>0 AND high/greatest(low,1.0)>8 AND on_samples/n_samples>0 AND on_samples/n_samples<0.75 AS is_pulsed
  FROM psum""", "ticks", **PULSE))
def _(spark, d):
    t, lv = _level(spark, d)
    s = P.pulse_windows(t, lv, KEY, "power", W_TICKS, block=128)[1]
    return s.select("capture_id", "n_samples", "on_samples", "n_windows", r(F.col("duty")).alias("duty"),
                    r(F.col("contrast")).alias("contrast"), "is_pulsed")


@query("pulse_windows", sql("SELECT * FROM pwin", "ticks", **PULSE))
def _(spark, d):
    t, lv = _level(spark, d)
    return P.pulse_windows(t, lv, KEY, "power", W_TICKS, block=128)[0]


@query("pulse_timing", sql("""SELECT capture_id, count(*) AS n_windows, round_even(median(end_sample-start_sample),0)::BIGINT AS pulse_width_samples,
  round_even(median(step),0)::BIGINT AS pri_samples FROM (SELECT *, start_sample-lag(start_sample) OVER (PARTITION BY capture_id ORDER BY start_sample) AS step
  FROM (SELECT capture_id, start AS start_sample, max("end") AS end_sample FROM detected_bands GROUP BY ALL)) GROUP BY 1""", "detected_bands"))
def _(spark, d):
    b = V.detected_bands(spark, d).groupBy("capture_id", F.col("start").alias("start_sample")).agg(F.max("end").alias("end_sample"))
    return P.pulse_timing(b, KEY)


@query("merge_intervals", sql("""SELECT capture_id, min(start) AS start_sample, max("end") AS end_sample, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY start, "end", det, excess, conf, lo ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT *, CASE WHEN start<=max("end") OVER (PARTITION BY capture_id ORDER BY start, "end", det, excess, conf, lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  THEN 0 ELSE 1 END AS new FROM detected_bands)) GROUP BY capture_id, g""", "detected_bands"))
def _(spark, d):
    m = PT.merge_intervals(V.detected_bands(spark, d), KEY, "start", "end", block=512)
    return m.select("capture_id", F.col("start").alias("start_sample"), F.col("end").alias("end_sample"), "n")


@query("clamp_to_core", sql("""SELECT capture_id, det, blk, greatest(start,blk*32) AS start_sample, least("end",blk*32+32) AS end_sample,
  list_sum(list_transform(w, lambda x: x[2]-x[1]))::BIGINT AS window_samples, len(w)::INTEGER AS n_windows FROM (
  SELECT *, list_filter(list_transform([[start,start+4],[start+6,start+20]], lambda x: [greatest(x[1],blk*32), least(x[2],blk*32+32)]), lambda x: x[2]>x[1]) AS w
  FROM (SELECT *, unnest(range(start//32, ("end"-1)//32+1)) AS blk FROM detected_bands))""", "detected_bands"))
def _(spark, d):
    st = F.col("start")
    win = F.array(F.struct(st.alias("start_sample"), (st + 4).alias("end_sample")),
                  F.struct((st + 6).alias("start_sample"), (st + 20).alias("end_sample")))
    b = V.detected_bands(spark, d).withColumn("blk", F.explode(F.sequence(F.floor(st / 32), F.floor((F.col("end") - 1) / 32))))
    b = b.select("capture_id", "det", "blk", st.alias("start_sample"), F.col("end").alias("end_sample"),
                 win.alias("pulse_windows"), (F.col("blk") * 32).alias("core_start"), (F.col("blk") * 32 + 32).alias("core_end"))
    total = F.aggregate("pulse_windows", F.lit(0).cast("long"), lambda a, w: a + w["end_sample"] - w["start_sample"])
    n = F.size("pulse_windows")
    return P.clamp_to_core(b).select("capture_id", "det", "blk", "start_sample", "end_sample",
                                     F.when(n > 0, total).alias("window_samples"), n.alias("n_windows"))


_ACT = "SELECT t.* FROM ticks t JOIN (SELECT capture_id, max(power) AS pk FROM ticks GROUP BY 1) USING (capture_id) WHERE power>pk*0.25"
_PACK = """SELECT capture_id, min(n) AS s, max(n)+1 AS e, count(*) AS c FROM (SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY n) AS g FROM (
  SELECT *, CASE WHEN n-lag(n) OVER (PARTITION BY capture_id ORDER BY n)<={gap} THEN 0 ELSE 1 END AS new FROM act)) GROUP BY capture_id, g"""


@query("strongest_packet", sql("""SELECT capture_id, count(*) OVER (PARTITION BY capture_id) AS n_packets, s AS start_sample, e AS end_sample, c AS active_samples
  FROM pack QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY e-s DESC, s)=1""", "ticks", act=_ACT, pack=_PACK.format(gap=4)))
def _(spark, d):
    return P.strongest_packet(V.ticks(spark, d), KEY, "power", 4, block=128)


@query("peak_region", sql("""SELECT capture_id, m AS peak_n, s AS start_sample, e AS end_sample FROM pack JOIN (SELECT capture_id,
  arg_max(n, (power,-n)) AS m FROM ticks GROUP BY 1) USING (capture_id) WHERE m>=s AND m<e""", "ticks", act=_ACT, pack=_PACK.format(gap=1)))
def _(spark, d):
    return P.peak_region(V.ticks(spark, d), KEY, "power", block=128)


FI = """SELECT a.capture_id, a.n, atan2(a.q*b.i-a.i*b.q, a.i*b.i+a.q*b.q)*32000.0/(2*pi()) AS fi FROM iq a JOIN iq b
  ON b.capture_id=a.capture_id AND b.n=a.n-1"""


@query("instantaneous_frequency", sql("SELECT capture_id, n, round(fi,4)+0.0 AS fi FROM fi", "iq", fi=FI))
def _(spark, d):
    return P.instantaneous_frequency(V.iq(spark, d), KEY, V.FS, 1024).select("capture_id", "n", r(F.col("fi"), 4).alias("fi"))


@query("tone_split", sql("""SELECT capture_id, round(l,4)+0.0 AS low_hz, round(h,4)+0.0 AS high_hz, round((l+h)/2,4)+0.0 AS centre_hz, round(h-l,4) AS split_hz,
  round((l+h)/2-((h-l)/2+1000),4)+0.0 AS band_lower_hz, round((l+h)/2+((h-l)/2+1000),4)+0.0 AS band_upper_hz FROM (SELECT capture_id, quantile_cont(s,0.15) AS l, quantile_cont(s,0.85) AS h FROM (
  SELECT a.capture_id, a.n, avg(b.fi) AS s FROM fi a JOIN longest w ON w.capture_id=a.capture_id AND a.n>=start_sample+4 AND a.n<end_sample-3
  JOIN fi b ON b.capture_id=a.capture_id AND b.n BETWEEN a.n-1 AND a.n+1 AND b.n>start_sample AND b.n<end_sample GROUP BY ALL) GROUP BY 1)""", "iq", fi=FI, loud=V.loud_sql(15), longest=V.LONGEST))
def _(spark, d):
    fi = P.instantaneous_frequency(V.iq(spark, d), KEY, V.FS, 1024)
    t = P.tone_split(fi, P.longest_window(V.loud_windows(spark, d, 15), KEY), KEY, 1024)
    lo, hi = P.expected_band(F.lit("FSK2"), F.col("centre_hz"), F.col("split_hz"), F.lit(1000.0))
    t = t.withColumn("band_lower_hz", lo).withColumn("band_upper_hz", hi)
    return t.select("capture_id", *[r(F.col(c), 4).alias(c) for c in t.columns[1:]])


_RUNS = """SELECT capture_id, blk, st, min(n) AS s, max(n)+1 AS e FROM (SELECT *, n-row_number() OVER (PARTITION BY capture_id, blk, st ORDER BY n) AS g
  FROM (SELECT capture_id, n//800 AS blk, n, i>q AS st FROM iq)) GROUP BY capture_id, blk, st, g"""
_ANCHOR = """SELECT capture_id, blk, st, s, coalesce(lead(s) OVER w, stop) AS e, row_number() OVER w AS rn, count(*) OVER (PARTITION BY capture_id, blk) AS cnt FROM (
  SELECT *, lag(st) OVER (PARTITION BY capture_id, blk ORDER BY s) AS prev FROM (SELECT *, max(e) OVER (PARTITION BY capture_id, blk) AS stop,
    row_number() OVER (PARTITION BY capture_id, blk ORDER BY s)=1 AS first FROM runs0) WHERE first OR e-s>=3)
  WHERE prev IS NULL OR prev<>st WINDOW w AS (PARTITION BY capture_id, blk ORDER BY s)"""


@query("run_length_encode", sql("""SELECT capture_id, blk, st AS state, CASE WHEN rn=2 AND lag(e-s) OVER w<3 THEN lag(s) OVER w ELSE s END AS start, e AS "end"
  FROM anchors WINDOW w AS (PARTITION BY capture_id, blk ORDER BY s) QUALIFY NOT (rn=1 AND cnt>1 AND e-s<3)""", "iq", runs0=_RUNS, anchors=_ANCHOR))
def _(spark, d):
    s = V.iq(spark, d).select("capture_id", F.floor(F.col("n") / 800).alias("blk"), "n", (F.col("i") > F.col("q")).alias("state"))
    keys = ["capture_id", "blk"]
    return P.run_length_encode(P.state_runs(s, keys, "n", "state"), keys, "state", 3)


def _two_level(rounds):
    extra = {"lv0": "SELECT capture_id, quantile_cont(power,0.1) AS lo, quantile_cont(power,0.9) AS hi FROM ticks GROUP BY 1"}
    for k in range(rounds):
        extra[f"lv{k + 1}"] = f"""SELECT capture_id, CASE WHEN l IS NOT NULL AND h IS NOT NULL THEN l ELSE lo END AS lo,
          CASE WHEN l IS NOT NULL AND h IS NOT NULL THEN h ELSE hi END AS hi FROM (SELECT capture_id, lo, hi,
          avg(power) FILTER (power<=(lo+hi)/2) AS l, avg(power) FILTER (power>(lo+hi)/2) AS h FROM ticks JOIN lv{k} USING (capture_id) GROUP BY ALL)"""
    return sql(f"SELECT capture_id, round(lo,6)+0.0 AS lo, round(hi,6) AS hi, round((lo+hi)/2,6) AS threshold FROM lv{rounds}", "ticks", **extra)


@query("two_level_threshold", _two_level(6))
def _(spark, d):
    t = written(V.ticks(spark, d))
    s = P.two_level_threshold(t, KEY, "power", PT.quantiles(t, KEY, "power", {"lo": 0.1, "hi": 0.9}), rounds=6)
    return s.select("capture_id", *[r(F.col(c)).alias(c) for c in ("lo", "hi", "threshold")])


_DIST = "SELECT DISTINCT capture_id, start AS start_sample, \"end\" AS end_sample FROM detected_bands"


def _windows(spark, d):
    return V.detected_bands(spark, d).select("capture_id", F.col("start").alias("start_sample"), F.col("end").alias("end_sample")).distinct()


@query("top_bursts", sql("""SELECT *, row_number() OVER w AS rank FROM win WINDOW w AS (PARTITION BY capture_id ORDER BY end_sample-start_sample DESC, start_sample, end_sample)
  QUALIFY row_number() OVER w<=3""", "detected_bands", win=_DIST))
def _(spark, d):
    return P.top_bursts(_windows(spark, d), KEY, 3).withColumn("rank", F.col("rank").cast("long"))


@query("joined_bursts", sql("""SELECT capture_id, start_sample, end_sample, "offset" FROM (SELECT *, coalesce(sum(end_sample-start_sample) OVER (PARTITION BY capture_id
  ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS "offset" FROM win) WHERE "offset"<60
  QUALIFY count(*) OVER (PARTITION BY capture_id)>=2""", "detected_bands", win=_DIST))
def _(spark, d):
    return P.joined_bursts(_windows(spark, d), KEY, 60)


_SEG = """SELECT x.capture_id, x.n, x.k, sum(y.i*h) AS i, sum(y.q*h) AS q FROM (SELECT v.capture_id, n, n+m-128 AS yn, h, n-start_sample AS k, start_sample, end_sample FROM iq v JOIN longest w
    ON w.capture_id=v.capture_id AND end_sample-start_sample>=1280 AND n>=start_sample+128 AND n<end_sample-128, taps) x
  JOIN mixed y ON y.capture_id=x.capture_id AND y.n=x.yn WHERE y.n>=start_sample AND y.n<end_sample GROUP BY ALL"""


@query("corrected_segment", sql("""SELECT capture_id, n, k, round(i*cos(a)+q*sin(a),6)+0.0 AS i, round(q*cos(a)-i*sin(a),6)+0.0 AS q, 'ok' AS status
  FROM (SELECT *, 2*pi()*250.0*k/32000.0 AS a FROM seg)
  UNION ALL SELECT capture_id, NULL, NULL, NULL, NULL, 'longest window under 1280 samples' FROM longest WHERE end_sample-start_sample<1280""",
                                "iq", taps=_TAPS, mixed=_MIXED, loud=V.loud_sql(31, 0.5), longest=V.LONGEST, seg=_SEG))
def _(spark, d):
    w = V.loud_windows(spark, d, 31, 0.5).withColumns({"lower_hz": F.lit(LO), "upper_hz": F.lit(HI)})
    return P.corrected_segment(V.blocks(spark, d), w, V.FS, F.lit(250.0)).withColumns({c: r(F.col(c)) for c in "iq"})


# Tracks: detections of consecutive blocks; block = days/100, band from the detection view
_TDET = """SELECT capture_id, start//100 AS block, det, lo, hi, start AS start_sample, "end" AS end_sample, conf, excess,
  CASE WHEN det%2=0 THEN 'occupied' ELSE 'extent' END AS method, conf<0.02 AS needs_review, det=3 AS is_pulsed FROM detected_bands"""


def _tdet(spark, d):
    return tdet(V.table(spark, d, "lineitem"))


def tdet(lineitem):
    b = V.bands_of(lineitem)
    return b.select("capture_id", F.floor(F.col("start") / 100).alias("block"), "det", "lo", "hi", F.col("start").alias("start_sample"),
                    F.col("end").alias("end_sample"), "conf", "excess",
                    F.when(F.col("det") % 2 == 0, "occupied").otherwise("extent").alias("method"),
                    (F.col("conf") < 0.02).alias("needs_review"), (F.col("det") == 3).alias("is_pulsed"))


@query("candidate_links", sql("""SELECT a.capture_id, a.block, a.det, a.excess, b.det AS prev_det, b.excess AS prev_excess,
  round(least(a.hi,b.hi)-greatest(a.lo,b.lo),6) AS overlap_hz FROM tdet a JOIN tdet b ON b.capture_id=a.capture_id AND b.block=a.block-1
  AND least(a.hi,b.hi)-greatest(a.lo,b.lo)>=0.5*least(a.hi-a.lo,b.hi-b.lo)""", "detected_bands", tdet=_TDET))
def _(spark, d):
    x = TR.candidate_links(_tdet(spark, d), 256.0)
    return x.select("capture_id", "block", "det", "excess", "prev_det", "prev_excess", r(F.col("overlap_hz")).alias("overlap_hz"))


ASSOCIATE_SQL = recursive(sql("SELECT o.capture_id, o.block, o.det, w.took AS track FROM ordered o JOIN walk w USING (capture_id, k)",
                              "detected_bands", tdet=_TDET, ordered=ORDERED_SQL, walk=WALK_SQL))


@query("associate_tracks", ASSOCIATE_SQL)
def _(spark, d):
    return TR.associate_tracks(_tdet(spark, d), 256.0).select("capture_id", "block", "det", "track")


@query("fold_tracks", sql("""SELECT capture_id, "track", min(start_sample) AS start_sample, max(end_sample) AS end_sample, round(min(lo),6)+0.0 AS lo, round(max(hi),6)+0.0 AS hi,
  min(conf) AS confidence, bool_or(needs_review) AS needs_review, bool_or(is_pulsed) AS is_pulsed, min(block) AS block_first, max(block) AS block_last,
  CASE WHEN count(DISTINCT method)>1 THEN 'mixed across blocks (union of per-block bounds)' ELSE min(method) END AS bounds_method
  FROM (SELECT *, floor(lo/100)::BIGINT AS "track" FROM tdet) GROUP BY ALL""", "detected_bands", tdet=_TDET))
def _(spark, d):
    t = _tdet(spark, d).withColumn("track", F.floor(F.col("lo") / 100))
    return TR.fold_tracks(t).withColumns({"lo": r(F.col("lo")), "hi": r(F.col("hi"))})


@query("track_windows", sql("""SELECT capture_id, "track", min(start_sample) AS start_sample, max(end_sample) AS end_sample FROM (
  SELECT *, sum(new) OVER (PARTITION BY capture_id, "track" ORDER BY start_sample, end_sample) AS g FROM (SELECT *, CASE WHEN start_sample<=max(end_sample) OVER
  (PARTITION BY capture_id, "track" ORDER BY start_sample, end_sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM (
  SELECT DISTINCT capture_id, floor(lo/100)::BIGINT AS "track", start_sample, end_sample FROM tdet))) GROUP BY capture_id, "track", g""", "detected_bands", tdet=_TDET))
def _(spark, d):
    t = _tdet(spark, d).withColumn("track", F.floor(F.col("lo") / 100))
    return PT.merge_intervals(t, ["capture_id", "track"], "start_sample", "end_sample", block=512).drop("n")


@query("track_envelope_pool", sql("""SELECT capture_id, n//30 AS "row", round(max(power),6) AS value, round(max(threshold),6) AS threshold
  FROM ticks JOIN level USING (capture_id) GROUP BY ALL""", "ticks", level=_LEVEL))
def _(spark, d):
    t, lv = _level(spark, d)
    e = t.join(lv.select("capture_id", "threshold"), KEY)
    x = TR.track_envelope_pool(e, KEY, F.floor(F.col("n") / 30), "power")
    return x.withColumns({c: r(F.col(c)) for c in ("value", "threshold")})


_SPANS = """SELECT DISTINCT o_orderkey, a AS start_sample, a+len AS end_sample FROM (SELECT o_orderkey, len, s+round_even(k*(span-len)/7,0)::BIGINT AS a FROM (
  SELECT o_orderkey, o_custkey AS s, o_totalprice::BIGINT AS span, least(o_totalprice::BIGINT, 80000//8) AS len, unnest(range(8)) AS k FROM orders WHERE o_totalprice::BIGINT>80000))"""


def _tracks(spark, d):
    o = V.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("track"), F.col("o_custkey").alias("start_sample"),
                    (F.col("o_custkey") + F.bround("o_totalprice").cast("long")).alias("end_sample"))


@query("sampled_spans", sql("SELECT o_orderkey AS track, start_sample, end_sample FROM spans", spans=_SPANS))
def _(spark, d):
    return TR.sampled_spans(_tracks(spark, d).where(F.col("end_sample") - F.col("start_sample") > 80000), ["track"], 80000)


@query("sampled_pulse_spans", sql("""SELECT DISTINCT capture_id, least(greatest(s0, w[p+1]), e0-20) AS start_sample, least(greatest(s0, w[p+1]), e0-20)+20 AS end_sample FROM (
  SELECT *, unnest(list_distinct(list_transform(range(8), lambda k: round_even(k*(len(w)-1)/7,0)::BIGINT))) AS p FROM (SELECT capture_id, list(start_sample ORDER BY start_sample, end_sample) AS w,
  min(start_sample) AS s0, max(end_sample) AS e0 FROM win GROUP BY 1) WHERE e0-s0>160)""", "detected_bands", win=_DIST))
def _(spark, d):
    w = _windows(spark, d)
    t = w.groupBy("capture_id").agg(F.min("start_sample").alias("start_sample"), F.max("end_sample").alias("end_sample"))
    return TR.sampled_pulse_spans(t.where(F.col("end_sample") - F.col("start_sample") > 160), w, KEY, 160)


@query("translate_windows", sql("""SELECT capture_id, start_sample, greatest(0,least(200,start_sample-2000)) AS a, greatest(0,least(200,end_sample-2000)) AS b FROM win
  WHERE greatest(0,least(200,end_sample-2000))>greatest(0,least(200,start_sample-2000))""", "detected_bands", win=_DIST))
def _(spark, d):
    w = _windows(spark, d).withColumn("pulse_windows", F.array(F.struct("start_sample", "end_sample")))
    x = w.withColumn("pulse_windows", TR.translate_windows(F.col("pulse_windows"), F.lit(2000), F.lit(2200)))
    return x.where(F.size("pulse_windows") > 0).select(
        "capture_id", "start_sample", F.col("pulse_windows")[0]["start_sample"].alias("a"), F.col("pulse_windows")[0]["end_sample"].alias("b"))


# the spans of the tracks of 100 captures; track numbers repeat between captures, some spans could not be analysed
_SPANRES = """SELECT *, CASE WHEN ok THEN count(*) FILTER (ok) OVER (PARTITION BY capture_id, track ORDER BY idx)-1 END AS pos FROM (
  SELECT capture_id, track, idx, ok, CASE WHEN ok THEN lab END AS label, CASE WHEN ok THEN rate END AS rate, CASE WHEN ok THEN score END AS cf,
  CASE WHEN ok THEN usage END AS bw3, CASE WHEN ok AND usage>0.04 THEN usage*2 END AS bw99, CASE WHEN ok THEN residual END AS snr FROM (
  SELECT candidate%100 AS capture_id, candidate//100 AS track, row_number() OVER (PARTITION BY candidate ORDER BY score, expert, label, residual, usage, rate)-1 AS idx,
  CASE WHEN label NOT IN ('none','FM') THEN label END AS lab, expert<>'null' AS ok, rate, score, usage, residual FROM hyps))"""


@query("combine_spans", sql("""SELECT capture_id, track, n_spans, n_spans-n_ok AS n_failed, round(cf,8) AS center_frequency_hz, round(bw3,8)+0.0 AS bandwidth_3db_hz,
  round(bw99,8)+0.0 AS bandwidth_99pct_hz, round(snr,8)+0.0 AS snr_db, CASE WHEN nl=1 AND 2*labelled>=n_spans THEN l END AS modulation_label,
  CASE WHEN nl=1 AND 2*labelled>=n_spans AND rated=labelled AND worst<=0.05*mr THEN round(mr,8)+0.0 END AS symbol_rate_hz, rep_idx,
  CASE WHEN nl=1 AND 2*labelled>=n_spans OR n_ok=0 THEN NULL WHEN nl>1 THEN 'not reliably estimated (sampled spans disagree: '||labels||')'
    ELSE 'not reliably estimated (a label on '||labelled||' of '||n_spans||' sampled spans, fewer than half)' END AS status
  FROM (SELECT s.capture_id, s.track, count(*) AS n_spans, count(*) FILTER (ok) AS n_ok, median(cf) AS cf, median(bw3) AS bw3, median(bw99) AS bw99, median(snr) AS snr,
    count(DISTINCT label) AS nl, count(label) AS labelled, string_agg(DISTINCT label, ', ' ORDER BY label) AS labels,
    min(label) AS l, median(rate) FILTER (label IS NOT NULL) AS mr, count(rate) FILTER (label IS NOT NULL) AS rated FROM spanres s GROUP BY ALL) a
  LEFT JOIN (SELECT capture_id, track, max(abs(rate-m)) AS worst FROM spanres JOIN (SELECT capture_id, track, median(rate) FILTER (label IS NOT NULL) AS m FROM spanres GROUP BY 1, 2)
    USING (capture_id, track) WHERE label IS NOT NULL GROUP BY 1, 2) b USING (capture_id, track)
  LEFT JOIN (SELECT capture_id, track, idx AS rep_idx FROM (SELECT *, count(*) OVER (PARTITION BY capture_id, track) AS n, count(*) FILTER (ok) OVER (PARTITION BY capture_id, track) AS nok,
    count(DISTINCT label) OVER (PARTITION BY capture_id, track) AS dl, count(label) OVER (PARTITION BY capture_id, track) AS nlab FROM spanres)
    WHERE ok AND (NOT (dl=1 AND 2*nlab>=n) OR label IS NOT NULL)
    QUALIFY row_number() OVER (PARTITION BY capture_id, track ORDER BY abs(pos-(nok-1)/2), idx)=1) c USING (capture_id, track)""", "hyps", spanres=_SPANRES))
def _(spark, d):
    from pyspark.sql import Window as W
    h = V.hypotheses(spark, d).withColumns({"capture_id": F.col("candidate") % 100, "track": F.floor(F.col("candidate") / 100)})
    w = W.partitionBy("capture_id", "track").orderBy("score", "expert", "label", "residual", "usage", F.col("rate").asc_nulls_last())
    s = h.select("capture_id", "track", (F.row_number().over(w) - 1).cast("long").alias("idx"),
                 F.when(~F.col("label").isin("none", "FM"), F.col("label")).alias("label"), "rate", (F.col("expert") != "null").alias("ok"),
                 F.col("score").alias("cf"), F.col("usage").alias("bw3"), F.when(F.col("usage") > 0.04, F.col("usage") * 2).alias("bw99"), F.col("residual").alias("snr"))
    c = TR.combine_spans(s)
    return c.withColumns({k: r(F.col(k), 8) for k in ("center_frequency_hz", "bandwidth_3db_hz", "bandwidth_99pct_hz", "snr_db", "symbol_rate_hz")})
