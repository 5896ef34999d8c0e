"""Registered queries: samples, frames, spectra, floors, bands."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import db, finite_or_null, r, baseband_to_rf, sample_to_time
from ..operators import blockbands as B, regions as R, spectra as S, validation as VA, wholetrack as WT
from . import views as V
from .analyze import analyze
from .registry import query
from .views import ORDERED_SQL, WALK_SQL, recursive, sql

DB = "10*log10(greatest({},1e-30))"


@query("validate_samples", sql("""SELECT capture_id, count(*) AS n_samples, bool_or(isnan(m) OR isinf(m)) AS not_finite,
  round(max(m),6) AS peak, CASE WHEN bool_or(isnan(m) OR isinf(m)) THEN 'contains NaN or infinite samples'
  WHEN max(m)>1e12 THEN 'sample magnitude is too large' WHEN count(*)<1024 THEN 'fewer than 1,024 samples' END AS reason
  FROM (SELECT capture_id, sqrt(i*i+q*q) AS m FROM iq) GROUP BY 1""", "iq"))
def _(spark, d):
    return VA.capture_health(V.iq(spark, d), ["capture_id"]).withColumn("peak", r(F.col("peak")))


@query("to_db", sql("""SELECT capture_id, n, round(10*log10(greatest(i*i+q*q,1e-30)),6)+0.0 AS power_db FROM iq""", "iq"))
def _(spark, d):
    return V.iq(spark, d).select("capture_id", "n", r(db(F.col("i") * F.col("i") + F.col("q") * F.col("q"))).alias("power_db"))


@query("sample_to_time", sql("""SELECT capture_id, det, round(start/32000.0,9) AS start_s, round("end"/32000.0,9) AS end_s,
  round(("end"-start)/32000.0,9) AS duration_s, round((lo+hi)/2,6)+0.0 AS center_hz, round(hi-lo,6) AS width_hz
  FROM detected_bands""", "detected_bands"))
def _(spark, d):
    b = V.detected_bands(spark, d)
    return b.select("capture_id", "det", r(sample_to_time(F.col("start"), V.FS), 9).alias("start_s"),
                    r(sample_to_time(F.col("end"), V.FS), 9).alias("end_s"),
                    r(sample_to_time(F.col("end") - F.col("start"), V.FS), 9).alias("duration_s"),
                    r((F.col("lo") + F.col("hi")) / 2).alias("center_hz"), r(F.col("hi") - F.col("lo")).alias("width_hz"))


@query("baseband_to_rf", """SELECT s_suppkey AS capture_id, round(s_acctbal+coalesce(t,0.0),4)+0.0 AS rf_hz
  FROM (SELECT *, CASE WHEN s_nationkey%3<>0 THEN s_nationkey*1e6::DOUBLE END AS t FROM supplier)""")
def _(spark, d):
    s = V.table(spark, d, "supplier")
    t = F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey") * 1e6)
    return s.select(F.col("s_suppkey").alias("capture_id"), r(baseband_to_rf(F.col("s_acctbal"), t), 4).alias("rf_hz"))


@query("finite_or_null", """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount=0 OR l_tax=0.04 THEN NULL
  ELSE l_extendedprice/l_discount END,4) AS v, [CASE WHEN l_discount>0 THEN round(l_tax/l_discount,6) END, round(l_tax,6)+0.0]
  AS vs FROM lineitem""")
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    div = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") == 0.04, F.lit(float("nan"))) \
        .otherwise(F.try_divide("l_extendedprice", "l_discount"))
    arr = F.array(F.when(F.col("l_discount") > 0, r(F.try_divide("l_tax", "l_discount"))).otherwise(F.lit(float("nan"))),
                  r(F.col("l_tax")))
    return li.select("l_orderkey", "l_linenumber", r(finite_or_null(div), 4).alias("v"),
                     F.transform(arr, finite_or_null).alias("vs"))


@query("check_coverage", sql("""SELECT capture_id, total AS n_samples, sum(core_end-core_start)::BIGINT AS processed,
  sum(core_end-core_start)=any_value(total) AS complete FROM blocks GROUP BY capture_id, total""", "blocks"))
def _(spark, d):
    return VA.check_coverage(V.blocks(spark, d), V.catalog(spark, d), ["capture_id"])


@query("check_limits", sql("""SELECT capture_id, count(*) AS n_tracks, count(*)<=40 AS within FROM bands GROUP BY ALL""", "bands"))
def _(spark, d):
    b = R.find_bands(V.frames(spark, d))
    ok, over = VA.check_limits(b, b, ["capture_id"], 40)
    n = ok.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n_tracks")).withColumn("within", F.lit(True))
    return n.union(over.select("capture_id", "n_tracks", F.lit(False)))


@query("null_downstream", sql("""SELECT capture_id, det, NULL::DOUBLE AS snr_db, NULL::VARCHAR AS modulation_label,
  NULL::INTEGER AS refinement_order, NULL::BOOLEAN AS label_needs_review, 'insufficient width' AS estimate_status,
  'insufficient width' AS verify_status FROM detected_bands WHERE hi-lo<8""", "detected_bands"))
def _(spark, d):
    b = V.detected_bands(spark, d).where(F.col("hi") - F.col("lo") < 8)
    return VA.null_downstream(b, "insufficient width").select(
        "capture_id", "det", "snr_db", "modulation_label", "refinement_order", "label_needs_review",
        "estimate_status", "verify_status")


@query("rf_budget", """SELECT o_orderkey, least(floor(o_totalprice*60.0),2000000)::BIGINT AS max_samples FROM orders""")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", VA.rf_budget(F.col("o_totalprice")).alias("max_samples"))


@query("blocks_with_guard", sql("""SELECT b.capture_id, b.block_id, lft, rgt, core_start, core_end,
  count(*) AS n_samples, round(sum(x.i),6)+0.0 AS sum_i, round(sum(x.q),6)+0.0 AS sum_q FROM blocks b JOIN iq x
  ON x.capture_id=b.capture_id AND x.n>=b.lft AND x.n<b.rgt GROUP BY ALL""", "blocks", "iq"))
def _(spark, d):
    add = lambda c: r(F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    b = V.blocks(spark, d)
    return b.select("capture_id", "block_id", "lft", (F.col("lft") + F.size("i")).alias("rgt"), "core_start", "core_end",
                    F.size("i").cast("long").alias("n_samples"), add("i").alias("sum_i"), add("q").alias("sum_q"))


@query("frames", sql("""SELECT f.capture_id, f.frame, round((16+f.frame*8)/32000.0,9) AS t, count(*) AS n_samples,
  min(x.n) AS first_n, round(sum(x.i*k),6)+0.0 AS weighted_i FROM (SELECT capture_id, unnest(range((total-32)//8+1)) AS frame
  FROM caps) f, (SELECT unnest(range(32)) AS k), iq x WHERE x.capture_id=f.capture_id AND x.n=f.frame*8+k GROUP BY ALL""",
  "caps", "iq"))
def _(spark, d):
    s = V.iq(spark, d).join(V.catalog(spark, d), "capture_id")
    f = S.frames_of_samples(s, V.NFFT, V.HOP, "n_samples", V.FS)
    return f.groupBy("capture_id", "frame", r(F.col("t"), 9).alias("t")).agg(
        F.count(F.lit(1)).alias("n_samples"), F.min("n").alias("first_n"), r(F.sum(F.col("i") * F.col("k"))).alias("weighted_i"))


@query("spectrogram", sql("SELECT capture_id, block_id, frame, bin, is_core, round(power*1e6,6)+0.0 AS power FROM cells", "cells"))
def _(spark, d):
    return V.cells(spark, d).select("capture_id", "block_id", "frame", F.col("bin").cast("long").alias("bin"), "is_core",
                                    r(F.col("power") * 1e6).alias("power"))


@query("welch_psd", sql("SELECT capture_id, block_id, bin, round((bin-16)*1000.0::DOUBLE,3)+0.0 AS frequency_hz, "
                        "round(power*1e6,6)+0.0 AS power FROM psd", "psd"))
def _(spark, d):
    return V.block_psd(spark, d).select("capture_id", "block_id", F.col("bin").cast("long").alias("bin"),
                                        r(S.bin_frequency(V.NFFT, V.FS), 3).alias("frequency_hz"),
                                        r(F.col("power") * 1e6).alias("power"))


@query("noise_floor_median", sql("SELECT capture_id, block_id, round(noise_floor*1e6,6) AS noise_floor, "
                                 f"round({DB.format('noise_floor')},6) AS noise_floor_db FROM floors", "floors"))
def _(spark, d):
    f = S.noise_floor_median(V.block_psd(spark, d), ["capture_id", "block_id"])
    return f.select("capture_id", "block_id", r(F.col("noise_floor") * 1e6).alias("noise_floor"),
                    r(db(F.col("noise_floor"))).alias("noise_floor_db"))


def _segments(n_expr):
    return f"greatest(1,({n_expr}-16)//16)"


# every segment count that a block of the view can have
_Q = S.gamma_quantile_table(list(range(1, 67)))
_Q_SQL = "CASE " + " ".join(f"WHEN k={k} THEN {v!r}" for k, v in _Q.items()) + " END"


@query("noise_floor_robust", sql(f"""SELECT capture_id, block_id, usable_bins, round(greatest(
  (CASE WHEN usable_bins>=16 THEN pu ELSE pa END)/({_Q_SQL}), med/pow(10,0.6), 1e-30)*1e6,6) AS noise_floor FROM (
  SELECT p.capture_id, p.block_id, {_segments('(b.rgt-b.lft)')} AS k, m.noise_floor AS med, count(*) FILTER (power>=m.noise_floor/10) AS usable_bins,
    quantile_cont(power,0.2) FILTER (power>=m.noise_floor/10) AS pu, quantile_cont(power,0.2) AS pa
  FROM psd p JOIN floors m USING (capture_id, block_id) JOIN blocks b USING (capture_id, block_id) GROUP BY ALL)""", "floors", "blocks"))
def _(spark, d):
    c = V.cells(spark, d)
    psd = S.welch_psd(c, ["capture_id", "block_id", "lft", "rgt"], 2, F.col("lft") / V.HOP)
    k = F.greatest(F.lit(1), F.floor((F.col("rgt") - F.col("lft") - 16) / 16)).cast("long")
    f = S.noise_floor_robust(psd, ["capture_id", "block_id", "lft", "rgt"], S.gamma_ratio(k))
    return f.select("capture_id", "block_id", "usable_bins", r(F.col("noise_floor") * 1e6).alias("noise_floor"))


@query("block_weighted_psd", sql("""SELECT capture_id, bin, round(sum(power*(core_end-core_start))/sum(core_end-core_start)*1e6,6)
  AS power FROM psd GROUP BY ALL""", "psd"))
def _(spark, d):
    p = S.block_weighted_psd(V.block_psd(spark, d), F.col("core_end") - F.col("core_start"))
    return p.select("capture_id", F.col("bin").cast("long").alias("bin"), r(F.col("power") * 1e6).alias("power"))


@query("floor_summary", sql("""SELECT capture_id, round(median(f),6) AS noise_floor_db, round(min(f),6) AS floor_min_db,
  round(max(f),6) AS floor_max_db, round(median(f)+3.0,6) AS threshold_db FROM (SELECT capture_id, 10*log10(noise_floor) AS f FROM floors)
  GROUP BY ALL""", "floors"))
def _(spark, d):
    f = V.frames(spark, d).groupBy("capture_id", "block_id").agg(F.first("floor").alias("noise_floor"))
    s = S.floor_summary(f, V.MARGIN_DB)
    return s.select("capture_id", *[r(F.col(c)).alias(c) for c in s.columns[1:]])


@query("adaptive_psd_length", """SELECT doc_id, greatest(64,least(1024,pow(2,floor(log2(greatest(n_chars//16,1))))))::BIGINT AS nper
  FROM documents""")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.adaptive_length(F.col("n_chars")).alias("nper"))


@query("mean_subset_psd", sql("""SELECT capture_id, bin, round(CASE WHEN min(core_end-core_start)>=800 THEN avg(power) END*1e6,6) AS power
  FROM psd GROUP BY ALL""", "psd"))
def _(spark, d):
    p = V.block_psd(spark, d).withColumn("len", F.col("core_end") - F.col("core_start"))
    m = S.mean_subset_psd(p, ["capture_id"], 800)
    return m.select("capture_id", F.col("bin").cast("long").alias("bin"), r(F.col("power") * 1e6).alias("power"))


@query("overview_maxpool", sql("""SELECT capture_id, "row", bin, round(max(power)*1e6,6) AS power FROM (SELECT s.*,
  least(least(60,(total-32)//8+1)-1, floor(((16+frame*8)/32000.0)/(total/32000.0)*least(60,(total-32)//8+1)))::BIGINT AS "row"
  FROM cells s JOIN caps USING (capture_id) WHERE is_core) GROUP BY ALL""", "cells", "caps"))
def _(spark, d):
    c = V.cells(spark, d).where("is_core").join(V.catalog(spark, d), "capture_id")
    rows = F.least(F.lit(60), F.floor((F.col("n_samples") - V.NFFT) / V.HOP) + 1)
    o = S.overview_maxpool(c, (V.NFFT / 2 + F.col("frame") * V.HOP) / V.FS, F.col("n_samples") / V.FS, rows)
    return o.select("capture_id", "row", F.col("bin").cast("long").alias("bin"), r(F.col("power") * 1e6).alias("power"))


@query("viewport_maxpool", sql("""SELECT capture_id, x, y, power, round(quantile_cont(pdb,0.05) OVER (PARTITION BY capture_id),6) AS low_db,
  round(max(pdb) OVER (PARTITION BY capture_id),6) AS high_db FROM (
  SELECT capture_id, x, y, round(max(power)*1e6,6) AS power, 10*log10(greatest(max(power),1e-30)) AS pdb FROM (
   SELECT s.capture_id, s.power, ceil((frame+1)*least(40,nf)::DOUBLE/nf)::BIGINT-1 AS x, ceil((bin+1)*10.0/32)::BIGINT-1 AS y
   FROM spec s JOIN (SELECT capture_id, (total-32)//8+1 AS nf FROM caps) USING (capture_id)) GROUP BY ALL)""", "spec", "caps"))
def _(spark, d):
    c = V.cells(spark, d).where("is_core").join(V.catalog(spark, d), "capture_id")
    v = S.viewport_maxpool(c, F.floor((F.col("n_samples") - V.NFFT) / V.HOP) + 1, V.NFFT, 40, 10)
    return v.select("capture_id", "x", "y", r(F.col("power") * 1e6).alias("power"), r(F.col("low_db")).alias("low_db"),
                    r(F.col("high_db")).alias("high_db"))


@query("waveform_maxpool", sql("""SELECT capture_id, ceil((n+1)*least(256,total)::DOUBLE/total)::BIGINT-1 AS bucket,
  round(max(sqrt(i*i+q*q)),6) AS value, min(n) AS first_n FROM iq JOIN caps USING (capture_id) GROUP BY ALL""", "iq", "caps"))
def _(spark, d):
    s = V.iq(spark, d).join(V.catalog(spark, d), "capture_id")
    return S.waveform_maxpool(s, F.col("n_samples"), 256).withColumn("value", r(F.col("value")))


@query("psd_thin", sql("SELECT capture_id, block_id, bin, round(power*1e6,6) AS power FROM psd WHERE bin%(greatest(1,32//8))=0", "psd"))
def _(spark, d):
    p = S.psd_thin(V.block_psd(spark, d), F.lit(V.NFFT), 8)
    return p.select("capture_id", "block_id", F.col("bin").cast("long").alias("bin"), r(F.col("power") * 1e6).alias("power"))


@query("smooth3x3", sql("SELECT capture_id, block_id, frame, bin, round(smooth*1e6,6) AS smooth FROM smooth", "smooth"))
def _(spark, d):
    return V.cells(spark, d, "smooth").select("capture_id", "block_id", "frame", F.col("bin").cast("long").alias("bin"),
                                              r(F.col("smooth") * 1e6).alias("smooth"))


@query("threshold_mask", sql("""SELECT capture_id, block_id, frame, bin, above,
  10*log10(greatest(smooth,1e-30)) > -50.0 AS above_fixed FROM mask""", "mask"))
def _(spark, d):
    c = V.cells(spark, d, "smooth").withColumn("bin", F.col("bin").cast("long"))
    a = R.threshold_mask(c, F.col("floor"), V.MARGIN_DB)
    f = R.threshold_mask(a.withColumnRenamed("above", "a"), F.col("floor"), fixed_db=-50.0)
    return f.select("capture_id", "block_id", "frame", "bin", F.col("a").alias("above"), F.col("above").alias("above_fixed"))


@query("open2x2", sql("SELECT capture_id, block_id, frame, bin FROM opened WHERE hit", "opened"))
def _(spark, d):
    return R.hit_cells(V.frames(spark, d)).withColumn("bin", F.col("bin").cast("long"))


@query("active_bins", sql("SELECT * FROM active", "active"))
def _(spark, d):
    a = R.active_bins(R.hit_cells(V.frames(spark, d)))
    return a.select(*R.KEYS, F.col("bin").cast("long").alias("bin"), "n_hit")


@query("bridge_gaps", sql("SELECT * FROM bands0", "bands0"))
def _(spark, d):
    b = R.bridge_gaps(R.active_bins(R.hit_cells(V.frames(spark, d))))
    return b.select(*R.KEYS, F.col("fa").cast("long").alias("fa"), F.col("fb").cast("long").alias("fb"))


@query("runs", sql("""SELECT capture_id, min(n) AS start_sample, max(n)+1 AS end_sample FROM (SELECT *, n-row_number() OVER
  (PARTITION BY capture_id ORDER BY n) AS g FROM iq WHERE i>q) GROUP BY capture_id, g""", "iq"))
def _(spark, d):
    from ..operators.partitioning import runs
    x = runs(V.iq(spark, d).where("i > q"), ["capture_id"], "n", block=1024)
    return x.select("capture_id", F.col("start").alias("start_sample"), F.col("end").alias("end_sample"))


@query("detect_bands", sql("SELECT * FROM bands", "bands"))
def _(spark, d):
    b = R.find_bands(V.frames(spark, d))
    return b.select(*R.KEYS, F.col("fa").cast("long").alias("fa"), F.col("fb").cast("long").alias("fb"),
                    "active_frames", "hit_cells")


@query("band_stats", sql("""SELECT c.capture_id, c.block_id, c.fa, c.fb, list_sort(list(DISTINCT frame)) AS frames,
  round(10*log10(max(smooth)),6) AS peak_db FROM band_cells c GROUP BY ALL""", "band_cells"))
def _(spark, d):
    f = R.hit_frames(V.frames(spark, d))
    s = R.band_stats(R.band_frames(R.as_parts(R.find_bands(f)), f))
    return s.select("capture_id", "block_id", F.col("fa").cast("long").alias("fa"), F.col("fb").cast("long").alias("fb"),
                    "frames", r(F.col("peak_db")).alias("peak_db"))


_ROWS = """SELECT capture_id, block_id, fa, fb, count(DISTINCT bin) AS n_bins, sum(e) AS excess,
 CASE WHEN count(DISTINCT bin)>=4 AND sum(e)>0 THEN least(coalesce(min(bin) FILTER (c>0.025), max(bin)), max(bin)) END AS b0,
 CASE WHEN count(DISTINCT bin)>=4 AND sum(e)>0 THEN coalesce(min(bin) FILTER (c>=0.975), max(bin))+1 END AS b1 FROM (
 SELECT *, sum(e) OVER (PARTITION BY capture_id, block_id, fa, fb ORDER BY bin)/nullif(sum(e) OVER (PARTITION BY capture_id, block_id, fa, fb),0) AS c
 FROM (SELECT capture_id, block_id, fa, fb, bin, greatest(avg(power)-any_value(noise_floor),0) AS e FROM band_cells GROUP BY ALL)) GROUP BY ALL"""
_PUBLISH = """SELECT *, greatest(-16000.0,(fa-16)*1000.0-500.0)::DOUBLE AS xl, least(16000.0,(fb-1-16)*1000.0+500.0)::DOUBLE AS xh,
 (b0-16)*1000.0-500.0 AS cl, (b1-1-16)*1000.0+500.0 AS ch FROM edges"""
_BOUNDS = """SELECT *, CASE WHEN b0 IS NULL THEN xl ELSE greatest(xl,(cl+ch)/2-1.6*(ch-cl)/2) END AS fl,
 CASE WHEN b0 IS NULL THEN xh ELSE least(xh,(cl+ch)/2+1.6*(ch-cl)/2) END AS fh,
 CASE WHEN b0 IS NULL THEN 'threshold extent' ELSE 'occupied 95% of power above the noise floor' END AS bounds_method FROM pub"""
EDGE_VIEWS = {"edges": _ROWS, "pub": _PUBLISH, "bounds": _BOUNDS}


def _band_cells(spark, d):
    f = R.hit_frames(V.frames(spark, d))
    return R.band_cells(R.band_frames(R.as_parts(R.find_bands(f)), f))


def _edges(spark, d):
    mean = _band_cells(spark, d).groupBy(*R.BAND, "bin", "floor").agg(F.avg("power").alias("power"))
    return R.refine_edges(mean, R.BAND, F.col("floor"))


def _long(df, *cols):
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


@query("refine_edges", sql("SELECT capture_id, block_id, fa, fb, n_bins, round(excess*1e6,6) AS excess, b0, b1 FROM edges",
                           "band_cells", edges=_ROWS))
def _(spark, d):
    return _long(_edges(spark, d).withColumn("excess", r(F.col("excess") * 1e6)), "fa", "fb", "b0", "b1")


@query("publish_bounds", sql("""SELECT capture_id, block_id, fa, fb, xl AS freq_extent_lower_hz, xh AS freq_extent_upper_hz,
  round(fl,6)+0.0 AS freq_lower_hz, round(fh,6)+0.0 AS freq_upper_hz, bounds_method FROM bounds""", "band_cells", **EDGE_VIEWS))
def _(spark, d):
    p = R.publish_bounds(_edges(spark, d), lambda b: (b - 16) * F.lit(1000.0), 1000.0, V.FS)
    return _long(p, "fa", "fb").select("capture_id", "block_id", "fa", "fb", "freq_extent_lower_hz", "freq_extent_upper_hz",
                                       r(F.col("freq_lower_hz")).alias("freq_lower_hz"),
                                       r(F.col("freq_upper_hz")).alias("freq_upper_hz"), "bounds_method")


@query("time_extent", sql("""SELECT capture_id, block_id, fa, fb, greatest(min(lft),min(frame)*8) AS start_sample,
  least(max(rgt),max(frame)*8+32) AS end_sample FROM band_cells GROUP BY ALL""", "band_cells"))
def _(spark, d):
    return _long(R.time_extent(_band_cells(spark, d), R.BAND, V.NFFT, V.HOP), "fa", "fb")


_EVID = f"""SELECT capture_id, block_id, fa, fb, 10*log10(greatest(quantile_cont(smooth,0.9),1e-30))-(10*log10(any_value(noise_floor))+{V.MARGIN_DB}) AS ex,
 avg(hit::INT) AS occ FROM band_cells GROUP BY ALL"""


@query("evidence_scores", sql("""SELECT capture_id, block_id, fa, fb, round(occ,6) AS occupancy, round(ex,6)+0.0 AS threshold_excess_db,
  round(least(greatest(0.48+0.38*(1-exp(-greatest(0,ex)/10))+0.12*occ,0),0.99),6) AS confidence,
  least(greatest(0.48+0.38*(1-exp(-greatest(0,ex)/10))+0.12*occ,0),0.99)<0.7 AS needs_review FROM ev""", "band_cells", ev=_EVID))
def _(spark, d):
    e = R.evidence_scores(_band_cells(spark, d), R.BAND, db(F.col("floor")) + V.MARGIN_DB)
    return _long(e, "fa", "fb").withColumns({c: r(F.col(c)) for c in ("occupancy", "threshold_excess_db", "confidence")})


_CV = """SELECT capture_id, block_id, fa, fb, abs(stddev_pop(x)/avg(x)-1) AS dev FROM (SELECT capture_id, block_id, fa, fb,
 power/avg(power) OVER (PARTITION BY capture_id, block_id, fa, fb, bin) AS x FROM band_cells) GROUP BY ALL"""


@query("power_cv_deviation", sql("""SELECT capture_id, block_id, fa, fb, round(dev,6) AS power_cv_deviation,
  round(least(greatest(0.48+0.5*(1-exp(-dev/0.2)),0),0.99),6) AS confidence_evidence_based FROM cv""", "band_cells", cv=_CV))
def _(spark, d):
    e = R.power_cv_deviation(_band_cells(spark, d), R.BAND)
    return _long(e, "fa", "fb").withColumns({c: r(F.col(c)) for c in ("power_cv_deviation", "confidence_evidence_based")})


def _sweep_sql():
    parts, extra = [], {}
    for m in (3, 4, 5):
        extra[f"m{m}"] = f"SELECT s.capture_id, s.block_id, s.frame, s.bin FROM smooth s JOIN floors f USING (capture_id, block_id) WHERE 10*log10(greatest(s.smooth,1e-30))>10*log10(f.noise_floor)+{m}.0"
        extra[f"q{m}"] = f"""SELECT a.* FROM m{m} a JOIN m{m} b ON b.capture_id=a.capture_id AND b.block_id=a.block_id AND b.frame=a.frame+1 AND b.bin=a.bin
          JOIN m{m} c ON c.capture_id=a.capture_id AND c.block_id=a.block_id AND c.frame=a.frame AND c.bin=a.bin+1
          JOIN m{m} d ON d.capture_id=a.capture_id AND d.block_id=a.block_id AND d.frame=a.frame+1 AND d.bin=a.bin+1"""
        extra[f"h{m}"] = f"SELECT DISTINCT capture_id, block_id, frame+df AS frame, bin+dk AS bin FROM q{m}, (SELECT unnest([0,1]) AS df), (SELECT unnest([0,1]) AS dk)"
        extra[f"b{m}"] = f"""SELECT capture_id, block_id, min(bin) AS fa, max(bin)+1 AS fb FROM (SELECT *, sum(new) OVER
          (PARTITION BY capture_id, block_id ORDER BY bin) AS g FROM (SELECT *, CASE WHEN bin-lag(bin) OVER (PARTITION BY capture_id, block_id ORDER BY bin)<=3
          THEN 0 ELSE 1 END AS new FROM (SELECT DISTINCT capture_id, block_id, bin FROM h{m}))) GROUP BY capture_id, block_id, g"""
        parts.append(f"""SELECT {m}.0::DOUBLE AS margin_db, b.capture_id, b.block_id, fa, fb, count(DISTINCT frame) AS active_frames, count(*) AS hit_cells
          FROM b{m} b JOIN h{m} h ON h.capture_id=b.capture_id AND h.block_id=b.block_id AND h.bin>=fa AND h.bin<fb WHERE fb-fa>=2 GROUP BY ALL
          HAVING count(DISTINCT frame)>=3 AND count(*)>=12""")
    return sql(" UNION ALL ".join(parts), "smooth", "floors", **extra)


@query("margin_sweep", _sweep_sql())
def _(spark, d):
    return _long(B.margin_sweep(V.blocks(spark, d), V.FS, V.NFFT, V.HOP, [3.0, 4.0, 5.0]), "fa", "fb")


@query("band_pairs", sql("SELECT * FROM bjoins", "bjoins"))
def _(spark, d):
    f = R.hit_frames(V.frames(spark, d))
    stats = R.band_stats(R.band_frames(R.as_parts(R.find_bands(f)), f))
    pairs = R.band_pairs(stats)
    j = R.joinable(pairs, R.pair_levels(pairs, stats, f, V.NFFT))
    return _long(j, "fa", "fb", "fa2", "fb2", "gap", "shared_frames")


@query("merge_fragments", sql("""SELECT capture_id, block_id, mfa AS fa, mfb AS fb, count(*) AS n_parts,
  sum(fb-fa)::BIGINT AS part_bins FROM merged_parts GROUP BY ALL""", "merged_parts"))
def _(spark, d):
    m = B.band_rows(V.blocks(spark, d), V.FS, V.NFFT, V.HOP, V.MARGIN_DB).where("fa is not null")
    return _long(m.select(*R.BAND, "n_parts", "part_bins"), "fa", "fb", "n_parts", "part_bins")


_M = {"edges": _ROWS.replace("band_cells", "merged_cells"), "pub": _PUBLISH, "bounds": _BOUNDS,
      "ev": _EVID.replace("band_cells", "merged_cells WHERE used"),
      "cv": _CV.replace("band_cells", "merged_cells WHERE used")}


@query("detections", sql("""SELECT capture_id, block_id, fa, fb, round(fl,6)+0.0 AS freq_lower_hz, round(fh,6)+0.0 AS freq_upper_hz,
  bounds_method, start_sample, end_sample, round(ex,6)+0.0 AS threshold_excess_db,
  round(least(greatest(0.48+0.38*(1-exp(-greatest(0,ex)/10))+0.12*occ,0),0.99),6) AS confidence, round(dev,6) AS power_cv_deviation, 'ok' AS status
  FROM bounds JOIN ev USING (capture_id, block_id, fa, fb) JOIN cv USING (capture_id, block_id, fa, fb) JOIN (
  SELECT capture_id, block_id, fa, fb, greatest(min(lft),min(frame)*8) AS start_sample, least(max(rgt),max(frame)*8+32) AS end_sample
  FROM merged_cells GROUP BY ALL) USING (capture_id, block_id, fa, fb)
  UNION ALL SELECT capture_id, block_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'fewer than 32 samples (' || (rgt-lft) || ')'
  FROM blocks WHERE rgt-lft<32""", "merged_cells", "blocks", **_M))
def _(spark, d):
    x = B.detect(V.blocks(spark, d), V.FS, V.NFFT, V.HOP, V.MARGIN_DB)
    return _long(x, "fa", "fb").select(
        "capture_id", "block_id", "fa", "fb", r(F.col("freq_lower_hz")).alias("freq_lower_hz"),
        r(F.col("freq_upper_hz")).alias("freq_upper_hz"), "bounds_method", "start_sample", "end_sample",
        r(F.col("threshold_excess_db")).alias("threshold_excess_db"), r(F.col("confidence")).alias("confidence"),
        r(F.col("power_cv_deviation")).alias("power_cv_deviation"), "status")


# Tracks of the whole-track measurement: equal merged bands of a capture, from their first to their last active frame
_TRK = """SELECT capture_id, fa*100+fb AS track, (fa-16)*1000.0::DOUBLE AS lo, (fb-16)*1000.0::DOUBLE AS hi, min(s) AS start_sample, max(e) AS end_sample FROM (
  SELECT capture_id, block_id, fa, fb, greatest(min(lft),min(frame)*8) AS s, least(max(rgt),max(frame)*8+32) AS e FROM merged_cells GROUP BY ALL) GROUP BY capture_id, fa, fb"""
_TF = """SELECT t.capture_id, t.track, any_value(lo) AS lo, any_value(hi) AS hi, bin, (bin-16)*1000.0::DOUBLE AS f, avg(power) AS power, count(*) AS n FROM trk t JOIN spec s ON
  s.capture_id=t.capture_id AND s.frame*8+16>=start_sample AND s.frame*8+16<end_sample GROUP BY t.capture_id, t.track, bin"""
_TS = """SELECT t.capture_id, t.track, count(*) AS n_samples, count(DISTINCT x.n//800) AS n_blocks, avg(x.i*x.i+x.q*x.q) AS m2, avg((x.i*x.i+x.q*x.q)**2) AS m4, max(x.i*x.i+x.q*x.q) AS peak,
  sum(x.i*y.i+x.q*y.q) AS re, sum(x.q*y.i-x.i*y.q) AS im FROM trk t JOIN iq x ON x.capture_id=t.capture_id AND x.n>=start_sample AND x.n<end_sample
  LEFT JOIN iq y ON y.capture_id=x.capture_id AND y.n=x.n-1 AND y.n>=start_sample GROUP BY ALL"""


@query("whole_tracks", sql("""SELECT capture_id, track, n_blocks, coalesce(n_frames,0) AS n_frames, n_samples, round(m2*1e3,6) AS mean_power, round(peak*1e3,6) AS peak,
  round(least(greatest(10*log10(s/greatest(m2-s,1e-12)),-10),30),6)+0.0 AS snr_db, round(atan2(im,re)*32000.0/(2*pi()),4)+0.0 AS mean_hz, round(c,4)+0.0 AS centroid_hz,
  round(share,6) AS inband_share, round(pd*1e6,6) AS peak_density, CASE WHEN n_frames IS NULL THEN 'no whole frame' ELSE 'measured' END AS status
  FROM (SELECT *, sqrt(greatest(2*m2*m2-m4,1e-12)) AS s FROM ts) LEFT JOIN (SELECT capture_id, track, any_value(n) AS n_frames,
    sum(power*f) FILTER (f>=lo AND f<hi)/sum(power) FILTER (f>=lo AND f<hi) AS c, sum(power) FILTER (f>=lo AND f<hi)/sum(power) AS share,
    max(power) FILTER (f>=lo AND f<hi) AS pd FROM tf GROUP BY ALL) USING (capture_id, track)""", "merged_cells", "spec", "iq", trk=_TRK, tf=_TF, ts=_TS))
def _(spark, d):
    x = B.band_rows(V.blocks(spark, d), V.FS, V.NFFT, V.HOP, V.MARGIN_DB).where("fa is not null")
    hz = lambda c: (F.col(c) - 16) * 1000.0
    t = x.groupBy("capture_id", (F.col("fa") * 100 + F.col("fb")).cast("long").alias("track"), hz("fa").alias("lo"), hz("fb").alias("hi")).agg(
        F.min(F.greatest("lft", F.col("f0") * V.HOP)).alias("start_sample"), F.max(F.least("rgt", F.col("f1") * V.HOP + V.NFFT)).alias("end_sample"))
    m = WT.measure_tracks(WT.track_partials(V.blocks(spark, d), t, V.FS, V.NFFT, V.HOP, V.BLOCK), t, V.FS, V.NFFT)
    return m.withColumns({"mean_power": r(F.col("mean_power") * 1e3), "peak": r(F.col("peak") * 1e3), "snr_db": r(F.col("snr_db")), "mean_hz": r(F.col("mean_hz"), 4),
                          "centroid_hz": r(F.col("centroid_hz"), 4), "inband_share": r(F.col("inband_share")), "peak_density": r(F.col("peak_density") * 1e6)})


# The whole analysis: clamped detections, the walk over blocks, folded tracks and their measurement
_ADET = """SELECT capture_id, block_id AS block, fa AS det, fl AS lo, fh AS hi, xl, xh, greatest(start_sample,block_id*800) AS start_sample, least(end_sample,(block_id+1)*800) AS end_sample,
  least(greatest(0.48+0.38*(1-exp(-greatest(0,ex)/10))+0.12*occ,0),0.99) AS conf, least(greatest(0.48+0.5*(1-exp(-dev/0.2)),0),0.99) AS ev, bounds_method, ex AS excess
  FROM bounds JOIN ev USING (capture_id, block_id, fa, fb) JOIN cv USING (capture_id, block_id, fa, fb) JOIN (
  SELECT capture_id, block_id, fa, fb, greatest(min(lft),min(frame)*8) AS start_sample, least(max(rgt),max(frame)*8+32) AS end_sample
  FROM merged_cells GROUP BY ALL) USING (capture_id, block_id, fa, fb) WHERE least(end_sample,(block_id+1)*800)>greatest(start_sample,block_id*800)"""
_ATRK = """SELECT o.capture_id, w.took AS track, min(lo) AS lo, max(hi) AS hi, min(xl) AS xl, max(xh) AS xh, min(start_sample) AS start_sample, max(end_sample) AS end_sample, min(conf) AS confidence,
  min(ev) AS ev, min(block) AS block_first, max(block) AS block_last, CASE WHEN count(DISTINCT bounds_method)>1 THEN 'mixed across blocks (union of per-block bounds)' ELSE min(bounds_method) END AS bounds_method
  FROM ordered o JOIN walk w USING (capture_id, k) GROUP BY ALL"""


@query("analyze_captures", recursive(sql("""SELECT t.capture_id, t.track AS id, start_sample, end_sample, round(lo,6)+0.0 AS freq_lower_hz, round(hi,6)+0.0 AS freq_upper_hz, round(xl,6)+0.0 AS freq_extent_lower_hz,
  round(xh,6)+0.0 AS freq_extent_upper_hz, round(confidence,6) AS confidence, round(ev,6) AS confidence_evidence_based, confidence<0.7 AS needs_review, block_first, block_last, bounds_method,
  s.n_blocks, coalesce(n_frames,0) AS n_frames, n_samples, round(m2*1e3,6) AS mean_power, round(least(greatest(10*log10(sqrt(greatest(2*m2*m2-m4,1e-12))/greatest(m2-sqrt(greatest(2*m2*m2-m4,1e-12)),1e-12)),-10),30),6)+0.0 AS snr_db,
  round(atan2(im,re)*32000.0/(2*pi()),4)+0.0 AS mean_hz, round(c,4)+0.0 AS centroid_hz, round(share,6) AS inband_share
  FROM trk t JOIN ts s USING (capture_id, track) LEFT JOIN (SELECT capture_id, track, any_value(n) AS n_frames,
    sum(power*f) FILTER (f>=lo AND f<hi)/sum(power) FILTER (f>=lo AND f<hi) AS c, sum(power) FILTER (f>=lo AND f<hi)/sum(power) AS share FROM tf GROUP BY ALL) USING (capture_id, track)""",
                                          "merged_cells", "spec", "iq", **_M, tdet=_ADET, ordered=ORDERED_SQL, walk=WALK_SQL, trk=_ATRK, tf=_TF, ts=_TS)))
def _(spark, d):
    a = analyze(V.blocks(spark, d), V.FS, V.NFFT, V.HOP, V.BLOCK, V.MARGIN_DB, group_hz=4000.0)
    x = a.tracks.select("capture_id", "id", "start_sample", "end_sample", *[r(F.col(c)).alias(c) for c in (
        "freq_lower_hz", "freq_upper_hz", "freq_extent_lower_hz", "freq_extent_upper_hz", "confidence", "confidence_evidence_based")],
        "needs_review", "block_first", "block_last", "bounds_method", "n_blocks", "n_frames", "n_samples", r(F.col("mean_power") * 1e3).alias("mean_power"),
        r(F.col("snr_db")).alias("snr_db"), r(F.col("mean_hz"), 4).alias("mean_hz"), r(F.col("centroid_hz"), 4).alias("centroid_hz"), r(F.col("inband_share")).alias("inband_share"))
    return x
