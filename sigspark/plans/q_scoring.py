"""Registered queries: truth matching, statistics, criteria, calibration, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..operators import calibration as C, scoring as M
from . import views as V
from .registry import query
from .views import sql

LM = ("coalesce({t}<>'noise' AND ({p}={t} OR ({p} IN ('QAM','FSK','ASK') AND regexp_replace({t},'\\d+$','')={p})),FALSE)")
FL = f"""SELECT *, {LM.format(p='label', t='truth')} AS label_ok, label IS NOT NULL AND NOT {LM.format(p='label', t='truth')} AS label_bad,
  coalesce(abs(rate-rate_true)/rate_true<0.05,FALSE) AS rate_ok, rate IS NOT NULL AND NOT coalesce(abs(rate-rate_true)/rate_true<0.05,FALSE) AS rate_bad,
  coalesce(snr_true>=5,FALSE) AS strong, truth='noise' AS noise FROM score_rows"""
SH = "round(count(*) FILTER ({c})/nullif(count(*) FILTER ({w}),0),6) AS {n}"


def sh(name, cond, among="TRUE"):
    return SH.format(c=f"({cond}) AND ({among})", w=among, n=name)


def fl(body):
    return sql(body, "score_rows", fl=FL)


def rnd(df, *cols):
    return df.withColumns({c: r(F.col(c)) for c in cols})


@query("label_matches", sql(f"""SELECT l_orderkey, line, truth, label, {LM.format(p='label', t='truth')} AS label_ok,
  coalesce(abs(rate-rate_true)/rate_true<0.05,FALSE) AS rate_ok, coalesce(abs(rate-2*rate_true)/(2*rate_true)<0.05,FALSE) OR
  coalesce(abs(rate-3*rate_true)/(3*rate_true)<0.05,FALSE) OR coalesce(abs(rate-rate_true/2)/(rate_true/2)<0.05,FALSE)
  OR coalesce(abs(rate-rate_true/3)/(rate_true/3)<0.05,FALSE) AS harmonic FROM score_rows""", "score_rows"))
def _(spark, d):
    s = V.score_rows(spark, d)
    return s.select("l_orderkey", "line", "truth", "label", M.label_matches(F.col("label"), F.col("truth")).alias("label_ok"),
                    M.rate_matches(F.col("rate"), F.col("rate_true")).alias("rate_ok"),
                    M.harmonic_error(F.col("rate"), F.col("rate_true")).alias("harmonic"))


LABEL_SQL = f"""SELECT gen, count(*) AS n, {sh('label_wrong', 'label_bad')}, count(*) FILTER (in_library AND strong) AS n_in_library,
  {sh('label_correct', 'label_ok', 'in_library AND strong')}, {sh('published', 'label IS NOT NULL')} FROM fl GROUP BY gen"""
RATE_SQL = f"""SELECT gen, count(*) AS n, {sh('rate_wrong', 'rate_bad')}, count(*) FILTER (digital AND strong) AS n_digital,
  {sh('rate_correct', 'rate_ok', 'digital AND strong')}, {sh('harmonic_errors', '''abs(rate-2*rate_true)/(2*rate_true)<0.05 OR
  abs(rate-3*rate_true)/(3*rate_true)<0.05 OR abs(rate-rate_true/2)/(rate_true/2)<0.05 OR abs(rate-rate_true/3)/(rate_true/3)<0.05''', 'digital AND strong')}
  FROM fl GROUP BY gen"""
CONF_SQL = f"""SELECT gen, count(*) FILTER (noise) AS n_noise, {sh('noise_labelled', 'label IS NOT NULL', 'noise')},
  count(*) FILTER (out_of_library) AS n_ool, {sh('ool_wrong', 'label_bad', 'out_of_library')}, count(*) FILTER (truth='FM') AS n_fm,
  {sh('fm_labelled', "coalesce(label='FM',FALSE)", "truth='FM'")}, count(*) FILTER (claim AND label IS NOT NULL) AS calibration_claims FROM fl GROUP BY gen"""
DET_SQL = f"""SELECT gen, count(*) FILTER (NOT noise AND strong) AS n_strong, {sh('recall', 'hit', 'NOT noise AND strong')},
  count(*) FILTER (noise) AS n_noise, {sh('noise_false', 'n_det>=1', 'noise')}, count(*) FILTER (NOT noise AND n_det>=1) AS n_found,
  {sh('fragmentation', 'n_det>=2', 'NOT noise AND n_det>=1')} FROM fl GROUP BY gen"""
LIN = "bw3_true IS NOT NULL AND bw3_true<>0 AND strong"
PAR_SQL = f"""SELECT gen, count(*) FILTER ({LIN}) AS n_linear, {sh('cf_ok', 'coalesce(abs(cf-fc)<=0.1*bw3_true,FALSE)', LIN)},
  {sh('bw3_ok', 'coalesce(abs(bw3/bw3_true-1)<=0.25,FALSE)', LIN)}, count(*) FILTER (NOT noise AND strong) AS n_signal,
  {sh('snr_ok', 'coalesce(abs(snr-snr_true)<=2,FALSE)', 'NOT noise AND strong')},
  round(quantile_cont(bw3/bw3_true,0.5) FILTER ({LIN}),6) AS median_bw3_ratio,
  round(quantile_cont(snr-snr_true,0.5) FILTER (NOT noise AND strong),6)+0.0 AS median_snr_err_db FROM fl GROUP BY gen"""
SPD_SQL = """SELECT gen, count(*) AS n, round(count(*) FILTER (time_s<=0.5)/count(*),6) AS within, round(max(time_s),6) AS max_s,
  round(quantile_cont(time_s,0.5),6) AS p50_s, round(quantile_cont(time_s,0.95),6) AS p95_s FROM fl GROUP BY gen"""


@query("label_stats", fl(LABEL_SQL))
def _(spark, d):
    return rnd(M.label_stats(V.score_rows(spark, d), ["gen"]), "label_wrong", "label_correct", "published")


@query("rate_stats", fl(RATE_SQL))
def _(spark, d):
    return rnd(M.rate_stats(V.score_rows(spark, d), ["gen"]), "rate_wrong", "rate_correct", "harmonic_errors")


@query("confidence_stats", fl(CONF_SQL))
def _(spark, d):
    return rnd(M.confidence_stats(V.score_rows(spark, d), ["gen"]), "noise_labelled", "ool_wrong", "fm_labelled")


@query("detect_stats", fl(DET_SQL))
def _(spark, d):
    return rnd(M.detect_stats(V.score_rows(spark, d), ["gen"]), "recall", "noise_false", "fragmentation")


@query("param_stats", fl(PAR_SQL))
def _(spark, d):
    return rnd(M.param_stats(V.score_rows(spark, d), ["gen"]), "cf_ok", "bw3_ok", "snr_ok", "median_bw3_ratio", "median_snr_err_db")


@query("speed_stats", fl(SPD_SQL))
def _(spark, d):
    return rnd(M.speed_stats(V.score_rows(spark, d), ["gen"]), "within", "max_s", "p50_s", "p95_s")


def _gen(spark, d):
    """Generators named as the criteria name them."""
    return V.score_rows(spark, d).withColumn("gen", F.when(F.col("gen") == "A", "G1").when(F.col("gen") == "N", "G2").otherwise("G4"))


_G = "CASE gen WHEN 'A' THEN 'G1' WHEN 'N' THEN 'G2' ELSE 'G4' END"
_LONG = " UNION ALL ".join(
    f"SELECT {_G} AS gen, '{k}' AS stat, {k}::DOUBLE AS value, {n} AS n FROM ({body})"
    for body, names in [(LABEL_SQL, {"label_wrong": "n", "label_correct": "n_in_library"}), (RATE_SQL, {"rate_wrong": "n", "rate_correct": "n_digital"}),
                        (CONF_SQL, {"noise_labelled": "n_noise", "ool_wrong": "n_ool", "calibration_claims": "n_noise"}),
                        (DET_SQL, {"recall": "n_strong", "noise_false": "n_noise", "fragmentation": "n_found"}),
                        (PAR_SQL, {"cf_ok": "n_linear", "bw3_ok": "n_linear", "snr_ok": "n_signal"}), (SPD_SQL, {"within": "n"})]
    for k, n in names.items())
_CRIT = "SELECT * FROM (VALUES " + ", ".join(f"('{i}','{s}','{t}',{lim}::DOUBLE,'{g}')" for i, s, t, lim, gens in M.CRITERIA for g in gens) + ") AS c(id,stat,test,bar,gen)"
_CRIT_ROWS = """SELECT *, coalesce(bool_and(gen_passed) OVER (PARTITION BY id),FALSE) AS passed FROM (SELECT c.*, s.value, s.n,
  CASE WHEN test='<=' THEN value<=bar ELSE value>=bar END AS gen_passed FROM crit c LEFT JOIN long s USING (stat, gen))"""
CRIT = {"fl": FL, "long": _LONG, "crit": _CRIT, "crows": _CRIT_ROWS}


@query("score_statistics", sql("SELECT gen, stat, round(value,6) AS value, n FROM long", "score_rows", fl=FL, long=_LONG))
def _(spark, d):
    return rnd(M.all_stats(_gen(spark, d), "gen"), "value")


@query("criteria", sql("SELECT id, stat, test, bar, gen, round(value,6) AS value, n, gen_passed, passed FROM crows", "score_rows", **CRIT))
def _(spark, d):
    return rnd(M.criteria(spark, M.all_stats(_gen(spark, d), "gen")), "value")


@query("criteria_pivot", sql("""SELECT id, passed, round(max(value) FILTER (gen='G1'),6) AS "G1", round(max(value) FILTER (gen='G2'),6) AS "G2",
  round(max(value) FILTER (gen='G4'),6) AS "G4" FROM crows GROUP BY ALL""", "score_rows", **CRIT))
def _(spark, d):
    c = M.criteria(spark, M.all_stats(_gen(spark, d), "gen"))
    return rnd(M.criteria_pivot(c, ["G1", "G2", "G4"]), "G1", "G2", "G4")


@query("gen_marks", sql("SELECT gen, bool_and(gen_passed) AS mark, count(gen_passed) AS n_applicable FROM crows GROUP BY gen", "score_rows", **CRIT))
def _(spark, d):
    return M.gen_marks(M.criteria(spark, M.all_stats(_gen(spark, d), "gen")))


@query("match_center_in_band", sql("""SELECT t.capture_id, truth_id, EXISTS (SELECT 1 FROM detected_bands x WHERE x.capture_id=t.capture_id AND lo<centre AND centre<hi)
  AS detected FROM (SELECT capture_id, truth_id, centre FROM truth_bands) t""", "truth_bands", "detected_bands"))
def _(spark, d):
    return M.match_center_in_band(V.truth_bands(spark, d), V.detected_bands(spark, d)).select("capture_id", "truth_id", "detected")


@query("flag_detections", sql("""SELECT d.capture_id, d.det, (SELECT count(*) FROM truth_bands t WHERE t.capture_id=d.capture_id AND d.lo<t.centre AND t.centre<d.hi) AS n_truth
  FROM detected_bands d""", "truth_bands", "detected_bands"))
def _(spark, d):
    return M.flag_detections(V.truth_bands(spark, d), V.detected_bands(spark, d)).select("capture_id", "det", "n_truth")


_BEST = """SELECT t.*, coalesce(n_det,0) AS n_det, coalesce(n_overlap,0) AS n_overlap, best_det, overlap_hz, best_lo, best_hi, best_det IS NOT NULL AS hit
  FROM truth_bands t LEFT JOIN (SELECT capture_id, count(*) AS n_det FROM detected_bands GROUP BY 1) USING (capture_id)
  LEFT JOIN (SELECT capture_id, truth_id, count(*) FILTER (ov>0) AS n_overlap FROM ovl GROUP BY 1, 2) USING (capture_id, truth_id)
  LEFT JOIN (SELECT capture_id, truth_id, det AS best_det, ov AS overlap_hz, dlo AS best_lo, dhi AS best_hi FROM ovl WHERE ov>0
  QUALIFY row_number() OVER (PARTITION BY capture_id, truth_id ORDER BY ov DESC, det, dlo DESC, dhi DESC)=1) USING (capture_id, truth_id)"""
_OVL = """SELECT d.capture_id, t.truth_id, d.det, d.lo AS dlo, d.hi AS dhi, least(d.hi,t.hi)-greatest(d.lo,t.lo) AS ov FROM detected_bands d JOIN truth_bands t USING (capture_id)"""
BEST = {"ovl": _OVL, "best": _BEST}


def _best(spark, d):
    return M.match_best_overlap(V.truth_bands(spark, d), V.detected_bands(spark, d))


@query("match_best_overlap", sql("""SELECT capture_id, truth_id, n_det, n_overlap, hit, best_det, round(overlap_hz,6) AS overlap_hz, round(best_lo,6)+0.0 AS best_lo
  FROM best""", "truth_bands", "detected_bands", **BEST))
def _(spark, d):
    b = _best(spark, d).select("capture_id", "truth_id", "n_det", "n_overlap", "hit", "best_det", "overlap_hz", "best_lo")
    return rnd(b, "overlap_hz", "best_lo")


@query("match_time_freq", sql("""SELECT capture_id, truth_id, det, excess, round(hi-lo,6) AS width_hz FROM (SELECT d.*, t.truth_id FROM detected_bands d JOIN truth_bands t ON
  d.capture_id=t.capture_id AND d.lo<=t.centre AND t.centre<=d.hi AND d.start<t."end" AND d."end">t.start)
  QUALIFY row_number() OVER (PARTITION BY capture_id, truth_id ORDER BY excess DESC, det, lo DESC, hi DESC)=1""", "truth_bands", "detected_bands"))
def _(spark, d):
    return rnd(M.match_time_freq(V.truth_bands(spark, d), V.detected_bands(spark, d)), "width_hz")


@query("width_ratio", sql("SELECT capture_id, truth_id, round(CASE WHEN hit THEN (best_hi-best_lo)/(hi-lo) END,6) AS width_ratio FROM best",
                          "truth_bands", "detected_bands", **BEST))
def _(spark, d):
    return rnd(M.width_ratio(_best(spark, d)).select("capture_id", "truth_id", "width_ratio"), "width_ratio")


@query("bounds_stats", sql(f"""SELECT kind, count(*) AS n, {sh('ok_bounds', 'coalesce(w>=0.5 AND w<=2,FALSE)')}, {sh('too_wide', 'coalesce(w>2,FALSE)')},
  {sh('too_narrow', 'coalesce(w<0.5,FALSE)')}, {sh('fragmented', 'n_overlap>1')} FROM (SELECT *, CASE WHEN hit THEN (best_hi-best_lo)/(hi-lo) END AS w FROM best)
  GROUP BY kind""", "truth_bands", "detected_bands", **BEST))
def _(spark, d):
    return rnd(M.bounds_stats(M.width_ratio(_best(spark, d)), ["kind"]), "ok_bounds", "too_wide", "too_narrow", "fragmented")


# Files: one per order; allowed labels and expected rate by the order key (fixed view rules)
_FILES = """SELECT o_orderkey AS f, CASE o_orderkey%4 WHEN 0 THEN ['BPSK','QPSK'] WHEN 1 THEN ['FSK2','FSK4'] WHEN 2 THEN []::VARCHAR[] ELSE ['QAM16'] END AS allowed,
  CASE WHEN o_orderkey%3=0 THEN 1000.0::DOUBLE END AS expected_rate FROM orders"""
_FDET = "SELECT l_orderkey AS f, line AS det, label, rate FROM score_rows"
_OUTC = f"""SELECT f, len(allowed)::INTEGER AS n_allowed, expected_rate IS NOT NULL AS rate_scored, coalesce(bool_or(pub AND ok),FALSE) AS correct, coalesce(bool_or(pub AND NOT ok),FALSE) AS wrong,
  coalesce(bool_or(expected_rate IS NOT NULL AND pub AND ok AND rate IS NOT NULL AND NOT coalesce(abs(rate-expected_rate)/expected_rate<0.05,FALSE)),FALSE) AS rate_wrong,
  coalesce(bool_or(expected_rate IS NOT NULL AND pub AND ok AND coalesce(abs(rate-expected_rate)/expected_rate<0.05,FALSE)),FALSE) AS rate_correct, count(det) AS n_detections
  FROM (SELECT *, label IS NOT NULL AS pub, len(list_filter(allowed, lambda a: {LM.format(p='label', t='a')}))>0 AS ok FROM files LEFT JOIN fdet USING (f)) GROUP BY ALL"""
FILES = {"files": _FILES, "fdet": _FDET, "outc": _OUTC.replace("GROUP BY ALL", "GROUP BY f, allowed, expected_rate")}


def _files(spark, d):
    k = F.col("o_orderkey")
    arr = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    allowed = F.when(k % 4 == 0, arr("BPSK", "QPSK")).when(k % 4 == 1, arr("FSK2", "FSK4")).when(k % 4 == 2, arr()).otherwise(arr("QAM16"))
    return V.table(spark, d, "orders").select(k.alias("f"), allowed.alias("allowed"), F.when(k % 3 == 0, 1000.0).alias("expected_rate"))


def _fdet(spark, d):
    return V.score_rows(spark, d).select(F.col("l_orderkey").alias("f"), F.col("line").alias("det"), "label", "rate")


@query("file_outcome", sql("SELECT * FROM outc", "score_rows", **FILES))
def _(spark, d):
    return M.file_outcome(_fdet(spark, d), _files(spark, d), ["f"])


@query("file_stats", sql(f"""SELECT count(*) AS n_test, count(*) FILTER (n_allowed>0) AS n_with_label, count(*) FILTER (rate_scored) AS n_rate_scored,
  {sh('correct', 'correct', 'n_allowed>0')}, {sh('wrong', 'wrong')}, {sh('rate_wrong', 'rate_wrong', 'rate_scored')}, {sh('rate_correct', 'rate_correct', 'rate_scored')}
  FROM outc""", "score_rows", **FILES))
def _(spark, d):
    s = M.file_stats(M.file_outcome(_fdet(spark, d), _files(spark, d), ["f"]))
    return rnd(s, "correct", "wrong", "rate_wrong", "rate_correct")


_SANITY = """SELECT f, list_filter([CASE WHEN n<3 THEN 'too few detections' END, CASE WHEN lab>0 THEN 'published label not allowed' END,
  CASE WHEN rt>0 THEN 'published rate off' END, CASE WHEN band AND nr=0 THEN 'no detection overlaps the band' END,
  CASE WHEN rp AND pulsed=0 THEN 'no pulsed detection where bursts are expected' END, CASE WHEN bw=0 THEN 'no detection with the expected 99% bandwidth' END,
  CASE WHEN wide<2 THEN 'too few wide detections' END], lambda x: x IS NOT NULL) AS notes FROM (
  SELECT f, f%2=0 AS band, f%5=0 AS rp, count(det) AS n, count(*) FILTER (label IS NOT NULL AND NOT list_contains(allowed,label)) AS lab,
  count(*) FILTER (list_contains(allowed,label) AND abs(rate-expected_rate)/expected_rate>0.05) AS rt,
  count(*) FILTER (det IS NOT NULL AND near) AS nr, count(*) FILTER (det IS NOT NULL AND near AND pulsed) AS pulsed,
  count(*) FILTER (det IS NOT NULL AND near AND bw99>=40 AND bw99<=120) AS bw, count(*) FILTER (bw99>=100) AS wide FROM (
  SELECT *, f%2<>0 OR (hi>200 AND lo<500) AS near FROM files LEFT JOIN (SELECT d.capture_id AS f, d.det, d.lo, d.hi, d.hi-d.lo AS bw99, d.det=3 AS pulsed, CASE WHEN d.det<=2 THEN 'BPSK' WHEN d.det=3 THEN 'FSK2' END AS label,
    d.excess*200 AS rate FROM detected_bands d) USING (f)) GROUP BY ALL)"""


@query("sanity_rules", sql("SELECT f, notes, len(notes)=0 AS passed FROM san", "detected_bands", files=_FILES, san=_SANITY))
def _(spark, d):
    det = V.detected_bands(spark, d).select(
        F.col("capture_id").alias("f"), "det", "lo", "hi", (F.col("hi") - F.col("lo")).alias("bw99"), (F.col("det") == 3).alias("is_pulsed"),
        F.when(F.col("det") <= 2, "BPSK").when(F.col("det") == 3, "FSK2").alias("label"), (F.col("excess") * 200).alias("rate"))
    k, two = F.col("f"), F.col("f") % 2 == 0
    files = _files(spark, d).withColumns({
        "min_detections": F.lit(3), "band_lo": F.when(two, 200.0), "band_hi": F.when(two, 500.0), "require_pulsed": k % 5 == 0,
        "bw_lo": F.lit(40.0), "bw_hi": F.lit(120.0), "wide_hz": F.lit(100.0), "wide_count": F.lit(2)})
    return M.sanity_rules(det, files, ["f"])


@query("realtime_factor", """SELECT count(*) AS n_files, round(sum(n_chars/b/1000.0),6) AS duration_s, round(sum(n_chars*1e-6),6) AS wall_s,
  round(sum(n_chars*1e-6)/sum(n_chars/b/1000.0),6) AS rtf FROM (SELECT *, CASE doc_id%3 WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 2 END AS b FROM documents)""")
def _(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, "cf32_le").when(F.col("doc_id") % 3 == 1, "ci16_le").otherwise("cu8")
    f = V.table(spark, d, "documents").select("n_chars", t.alias("datatype"), F.lit(1000.0).alias("rate"))
    return rnd(M.realtime_factor(f, "datatype", "n_chars", "rate", F.col("n_chars") * 1e-6), "duration_s", "wall_s", "rtf")


@query("accuracy_curve", fl("SELECT kind, snr_true, count(*) AS trials, count(*) FILTER (label_ok) AS passed, round(count(*) FILTER (label_ok)/count(*),6) AS accuracy FROM fl GROUP BY ALL"))
def _(spark, d):
    return rnd(M.accuracy_curve(M.flags(V.score_rows(spark, d)), F.col("label_ok")), "accuracy")


@query("evidence_projection", fl(f"""SELECT gen, section, metric, value FROM (SELECT gen, {sh('label_wrong', 'label_bad')}, {sh('label_correct', 'label_ok', 'in_library AND strong')},
  {sh('rate_wrong', 'rate_bad')}, {sh('rate_correct', 'rate_ok', 'digital AND strong')} FROM fl GROUP BY gen), LATERAL (VALUES ('label','published_wrong',label_wrong),
  ('label','published_correct_in_library',label_correct), ('rate','published_wrong',rate_wrong), ('rate','published_correct_digital',rate_correct)) v(section,metric,value)"""))
def _(spark, d):
    s = V.score_rows(spark, d)
    j = M.label_stats(s, ["gen"]).select("gen", "label_wrong", "label_correct").join(
        M.rate_stats(s, ["gen"]).select("gen", "rate_wrong", "rate_correct"), "gen")
    return rnd(j.selectExpr("gen", """stack(4, 'label','published_wrong',label_wrong, 'label','published_correct_in_library',label_correct,
      'rate','published_wrong',rate_wrong, 'rate','published_correct_digital',rate_correct) AS (section, metric, value)"""), "value")


_CAUSE = """CASE WHEN label IS NOT NULL THEN CASE WHEN label_ok THEN 'correct label' ELSE 'WRONG label' END WHEN n_det=0 THEN 'detect_miss'
  WHEN line=6 THEN 'm_fam' ELSE 'unexplained' END"""


def _caused(spark, d):
    c = F.when(F.col("label").isNotNull(), F.when(F.col("label_ok"), "correct label").otherwise("WRONG label")) \
        .when(F.col("n_det") == 0, "detect_miss").when(F.col("line") == 6, "m_fam").otherwise("unexplained")
    return M.flags(V.score_rows(spark, d)).withColumn("cause", c)


@query("cause_table", fl(f"""SELECT gen, cause, n, round(n/sum(n) OVER (PARTITION BY gen),6) AS share, row_number() OVER (PARTITION BY gen ORDER BY n DESC, cause) AS place
  FROM (SELECT gen, {_CAUSE} AS cause, count(*) AS n FROM fl GROUP BY ALL)"""))
def _(spark, d):
    return rnd(M.cause_table(_caused(spark, d), "gen", "cause"), "share").withColumn("place", F.col("place").cast("long"))


@query("truth_by_cause", fl(f"""SELECT truth, count(*) FILTER (c='correct label') AS correct, count(*) FILTER (c='WRONG label') AS wrong, count(*) FILTER (c='detect_miss') AS detect_miss,
  count(*) FILTER (c='m_fam') AS m_fam, count(*) FILTER (c='unexplained') AS unexplained FROM (SELECT truth, {_CAUSE} AS c FROM fl) GROUP BY truth"""))
def _(spark, d):
    names = {"correct label": "correct", "WRONG label": "wrong", "detect_miss": "detect_miss", "m_fam": "m_fam", "unexplained": "unexplained"}
    p = _caused(spark, d).groupBy("truth").pivot("cause", list(names)).count().na.fill(0)
    return p.select("truth", *[F.col(f"`{a}`").alias(b) for a, b in names.items()])


@query("primary_per_file", fl("""SELECT l_orderkey, line, label, truth FROM fl QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY coalesce(snr,-99) DESC,
  line DESC, margin DESC, label DESC NULLS LAST, truth DESC)=1"""))
def _(spark, d):
    p = M.primary_per_file(V.score_rows(spark, d), ["l_orderkey"], ["line", "margin", "label", "truth"])
    return p.drop("margin")


@query("snr_band_table", fl(f"""SELECT CASE WHEN coalesce(snr_true,99)<5 THEN '<5' WHEN coalesce(snr_true,99)<10 THEN '5..10' WHEN coalesce(snr_true,99)<15 THEN '10..15' ELSE '>15' END AS band,
  count(*) AS n, {sh('abstained', 'label IS NULL')}, {sh('correct', 'label_ok')} FROM fl GROUP BY 1"""))
def _(spark, d):
    from ..functions.expr import share
    s = M.flags(V.score_rows(spark, d)).groupBy(M.snr_band(F.col("snr_true")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), share(F.col("label").isNull()).alias("abstained"), share(F.col("label_ok")).alias("correct"))
    return rnd(s, "abstained", "correct")


@query("auc_pairs", fl("""SELECT count(*) FILTER (g) AS n_good, count(*) FILTER (NOT g) AS n_bad, round((sum(rk) FILTER (g) - count(*) FILTER (g)*(count(*) FILTER (g)+1)/2)
  /(count(*) FILTER (g)*1.0::DOUBLE*count(*) FILTER (NOT g)),6) AS auc FROM (SELECT label_ok AS g, rank() OVER (ORDER BY margin) + (count(*) OVER (PARTITION BY margin)-1)/2 AS rk FROM fl WHERE label IS NOT NULL)"""))
def _(spark, d):
    return rnd(M.auc_pairs(M.flags(V.score_rows(spark, d)).where("label IS NOT NULL"), "margin", F.col("label_ok")), "auc")


@query("spread_summary", sql("""SELECT kind, count(*) AS n, round(list_sort(list(w))[count(*)*1//10+1],6) AS p10, round(list_sort(list(w))[count(*)*9//10+1],6) AS p90,
  round(count(*) FILTER (w>2)/count(*),6) AS over_2, round(count(*) FILTER (w<0.5)/count(*),6) AS under_half, round(median(w),6) AS median
  FROM (SELECT kind, (best_hi-best_lo)/(hi-lo) AS w FROM best WHERE hit) GROUP BY kind""", "truth_bands", "detected_bands", **BEST))
def _(spark, d):
    w = M.width_ratio(_best(spark, d)).where("hit").select("kind", "capture_id", "width_ratio")
    return rnd(M.spread_summary(w, ["kind"], "width_ratio"), "p10", "p90", "over_2", "under_half", "median")


@query("proposal_recall", sql("""SELECT band, count(*) AS n, round(100.0::DOUBLE*count(*) FILTER (hit)/count(*),6) AS recall FROM (SELECT CASE WHEN snr_true>=4 THEN '>=4' WHEN snr_true>=-1 THEN '-1..4' ELSE '<-1' END AS band,
  len(list_filter([rate_true*0.5, coalesce(rate,0.0), rate_true*(1+l)], lambda p: abs(p-rate_true)/rate_true<0.02))>0 AS hit
  FROM (SELECT *, line/100.0::DOUBLE AS l FROM score_rows) WHERE digital) GROUP BY band""", "score_rows"))
def _(spark, d):
    t = F.col("rate_true")
    s = V.score_rows(spark, d).where("digital").withColumn("props", F.array(t * 0.5, F.coalesce("rate", F.lit(0.0)), t * (1 + F.col("line") / 100.0)))
    hit = F.exists("props", lambda p: F.abs(p - t) / t < 0.02)
    band = F.when(F.col("snr_true") >= 4, ">=4").when(F.col("snr_true") >= -1, "-1..4").otherwise("<-1")
    return s.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), r(100.0 * F.count_if(hit) / F.count(F.lit(1))).alias("recall"))


@query("kind_by_snr_accuracy", fl("""SELECT truth, b AS snr_bin, count(*) AS n, round(100.0::DOUBLE*count(*) FILTER (label_ok)/count(*),6) AS label_acc,
  round(100.0::DOUBLE*count(*) FILTER (rate_ok)/nullif(count(*) FILTER (digital),0),6) AS rate_acc FROM (SELECT *, CASE WHEN snr_true<5 THEN 'a <5' WHEN snr_true<15 THEN 'b 5..15' ELSE 'c >=15' END AS b FROM fl)
  GROUP BY ROLLUP (truth, b)"""))
def _(spark, d):
    b = F.when(F.col("snr_true") < 5, "a <5").when(F.col("snr_true") < 15, "b 5..15").otherwise("c >=15")
    s = M.flags(V.score_rows(spark, d)).withColumn("snr_bin", b)
    return s.rollup("truth", "snr_bin").agg(
        F.count(F.lit(1)).alias("n"), r(100.0 * F.count_if("label_ok") / F.count(F.lit(1))).alias("label_acc"),
        r(100.0 * F.count_if("rate_ok") / F.nullif(F.count_if("digital").cast("double"), F.lit(0.0))).alias("rate_acc"))


_COND = """CASE WHEN line=1 THEN 'none' WHEN line=2 THEN 'all' WHEN line IN (3,4,5) THEN 'only:'||kind ELSE 'without:'||kind END"""


@query("ablation_effects",
      sql("""SELECT factor, round((SELECT max(v) FROM s WHERE c='none')-max(v) FILTER (c LIKE 'only:%'),6)+0.0 AS cost,
  round(max(v) FILTER (c LIKE 'without:%')-(SELECT max(v) FROM s WHERE c='all'),6)+0.0 AS recovery FROM (SELECT c, v, split_part(c,':',2) AS factor FROM s) WHERE factor<>'' GROUP BY factor""",
          "score_rows", fl=FL, s=f"SELECT {_COND} AS c, count(*) FILTER (label_ok)/count(*) AS v FROM fl GROUP BY 1"))
def _(spark, d):
    ln, kind = F.col("line"), F.col("kind")
    cond = F.when(ln == 1, "none").when(ln == 2, "all").when(ln.isin(3, 4, 5), F.concat(F.lit("only:"), kind)).otherwise(F.concat(F.lit("without:"), kind))
    s = M.flags(V.score_rows(spark, d)).groupBy(cond.alias("condition")).agg((F.count_if("label_ok") / F.count(F.lit(1))).alias("correct"))
    return rnd(M.ablation_effects(s), "cost", "recovery")


@query("stage_timing_table", """SELECT stage, round(avg(ms),6) AS mean, round(max(ms),6) AS max, count(*) FILTER (ms>1000) AS over_budget, round(quantile_cont(ms,0.5),6) AS p50,
  round(quantile_cont(ms,0.95),6) AS p95 FROM (SELECT 'quantity' AS stage, l_quantity*30 AS ms FROM lineitem UNION ALL SELECT 'price', l_extendedprice/50 FROM lineitem
  UNION ALL SELECT 'tax', l_tax*1000 FROM lineitem) GROUP BY stage""")
def _(spark, d):
    li = V.table(spark, d, "lineitem")
    long = li.selectExpr("stack(3, 'quantity', l_quantity*30, 'price', l_extendedprice/50, 'tax', l_tax*1000) AS (stage, ms)")
    return rnd(M.stage_timing_table(long, 1000.0), "mean", "max", "p50", "p95")


@query("run_totals", fl("""SELECT count(DISTINCT l_orderkey) AS files, count(*) AS detections, count(label) AS labelled, count(*)-count(label) AS abstained,
  count(*) FILTER (snr IS NULL) AS errors FROM fl"""))
def _(spark, d):
    # files counted in two steps: distinct keys spread over tasks, then one sum
    s = V.score_rows(spark, d)
    per = s.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("k"), F.count_if(F.col("snr").isNull()).alias("e"))
    return per.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("detections"), F.sum("k").alias("labelled"),
                   (F.sum("n") - F.sum("k")).alias("abstained"), F.sum("e").alias("errors"))


@query("panel_stats", sql("""SELECT capture_id, count(*) AS total, count(*) FILTER (det=3) AS pulsed, count(*) FILTER (conf<0.02) AS review, round(avg(conf),6) AS mean_confidence
  FROM detected_bands GROUP BY 1""", "detected_bands"))
def _(spark, d):
    b = V.detected_bands(spark, d)
    return b.groupBy("capture_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("det") == 3).alias("pulsed"),
                                       F.count_if(F.col("conf") < 0.02).alias("review"), r(F.avg("conf")).alias("mean_confidence"))


@query("latest_runs", """SELECT job_id, ts, event_id FROM (SELECT user_id AS job_id, epoch_us(ts) AS ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC)=1) ORDER BY ts DESC, job_id LIMIT 10""")
def _(spark, d):
    e = V.table(spark, d, "events")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return M.latest_runs(e.select(F.col("user_id").alias("job_id"), us.alias("ts"), "event_id"))


@query("incremental_rows", """SELECT o_orderkey AS id, CASE WHEN l.k IS NOT NULL THEN 'cached' ELSE 'computed' END AS how, CASE WHEN l.k IS NOT NULL THEN p ELSE o_totalprice END AS v
  FROM orders LEFT JOIN (SELECT l_orderkey AS k, round(max(l_extendedprice),2) AS p FROM lineitem GROUP BY 1) l ON k=o_orderkey""")
def _(spark, d):
    o, li = V.table(spark, d, "orders"), V.table(spark, d, "lineitem")
    cache = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.max("l_extendedprice"), 2).alias("v")).withColumn("how", F.lit("cached"))
    cache = cache.join(o, F.col("id") == F.col("o_orderkey"), "left_semi")
    fresh = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"), F.lit("computed").alias("how"))
    return M.incremental_rows(cache, fresh, "id")


@query("refresh_flags", sql("""SELECT l_orderkey, line, truth, truth IN ('BPSK','QPSK','8PSK','QAM16','FSK2','FSK4','ASK2') AS in_library,
  truth IN ('FSK8','QAM8','QAM64') AS out_of_library FROM score_rows""", "score_rows"))
def _(spark, d):
    s = V.score_rows(spark, d).select("l_orderkey", "line", "truth")
    return M.refresh_flags(s, ["BPSK", "QPSK", "8PSK", "QAM16", "FSK2", "FSK4", "ASK2"], ["FSK8", "QAM8", "QAM64"])


@query("decision_table", fl("""SELECT truth, count(*) AS n, round(100.0::DOUBLE*count(label)/count(*),6) AS label_shipped, round(100.0::DOUBLE*count(*) FILTER (label IS NOT NULL AND label_ok)/nullif(count(label),0),6) AS label_right,
  round(100.0::DOUBLE*count(*) FILTER (line=6)/count(*),6) AS unknown, round(100.0::DOUBLE*count(rate)/count(*),6) AS rate_shipped, round(100.0::DOUBLE*count(*) FILTER (rate_ok)/nullif(count(rate),0),6) AS rate_right,
  count(*) FILTER (label_bad OR rate_bad) AS confidently_wrong FROM fl WHERE l_orderkey%2=1 GROUP BY truth"""))
def _(spark, d):
    # the held-out half: odd captures
    s = M.flags(V.score_rows(spark, d)).where(F.col("l_orderkey") % 2 == 1)
    n, dbl = F.count(F.lit(1)), lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    return s.groupBy("truth").agg(
        n.alias("n"), r(100.0 * F.count("label") / n).alias("label_shipped"),
        r(100.0 * F.count_if(F.col("label").isNotNull() & F.col("label_ok")) / dbl(F.count("label"))).alias("label_right"),
        r(100.0 * F.count_if(F.col("line") == 6) / n).alias("unknown"), r(100.0 * F.count("rate") / n).alias("rate_shipped"),
        r(100.0 * F.count_if("rate_ok") / dbl(F.count("rate"))).alias("rate_right"),
        F.count_if(F.col("label_bad") | F.col("rate_bad")).alias("confidently_wrong"))


@query("tolerance_join", sql("""SELECT l.capture_id, l.det, l.excess FROM detected_bands l WHERE EXISTS (SELECT 1 FROM (SELECT capture_id, lo+det*0.3 AS lo, hi-det*0.2 AS hi FROM detected_bands) x
  WHERE x.capture_id=l.capture_id AND abs(x.lo-l.lo)<1e-6*greatest(1,abs(l.lo))+1 AND abs(x.hi-l.hi)<1e-6*greatest(1,abs(l.hi))+1)""", "detected_bands"))
def _(spark, d):
    b = V.detected_bands(spark, d)
    moved = b.select("capture_id", (F.col("lo") + F.col("det") * 0.3).alias("lo"), (F.col("hi") - F.col("det") * 0.2).alias("hi"))
    return M.tolerance_join(b, moved, ["capture_id"]).select("capture_id", "det", "excess")


@query("carson_ratio", sql("""SELECT kind, count(*) AS n_rated, count(*) FILTER (x>=0.5 AND x<=2) AS ok, count(*) FILTER (x>2) AS wide, count(*) FILTER (x<0.5) AS narrow,
  count(*) FILTER (x IS NULL) AS missing, round(avg(x),6) AS mean_ratio FROM (SELECT kind, (best_hi-best_lo)/(abs(centre)/10+2*12.5) AS x FROM best) GROUP BY kind""", "truth_bands", "detected_bands", **BEST))
def _(spark, d):
    x = M.carson_ratio(F.col("best_hi") - F.col("best_lo"), F.abs("centre") / 10, F.lit(12.5))
    b = _best(spark, d).withColumn("x", x)
    return b.groupBy("kind").agg(F.count(F.lit(1)).alias("n_rated"), F.count_if((F.col("x") >= 0.5) & (F.col("x") <= 2)).alias("ok"),
                                 F.count_if(F.col("x") > 2).alias("wide"), F.count_if(F.col("x") < 0.5).alias("narrow"),
                                 F.count_if(F.col("x").isNull()).alias("missing"), r(F.avg("x")).alias("mean_ratio"))


@query("stride_sample", "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS rn FROM events WHERE event_type<>'error') WHERE (rn-1)%4=0")
def _(spark, d):
    e = V.table(spark, d, "events").where("event_type <> 'error'").select("event_id", "user_id")
    return M.stride_sample(e, "event_id", 4, F.floor(F.col("event_id") / 4096))


@query("counterfactual_outcomes", fl(f"""SELECT truth, coalesce(label, {_CAUSE}) AS outcome, count(*) AS n, count(*) FILTER (label_ok) AS correct_if_lifted, count(*) FILTER (label_bad) AS wrong_if_lifted
  FROM fl WHERE line>=4 GROUP BY ALL"""))
def _(spark, d):
    s = _caused(spark, d).where("line >= 4")
    return s.groupBy("truth", F.coalesce("label", "cause").alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("label_ok").alias("correct_if_lifted"), F.count_if("label_bad").alias("wrong_if_lifted"))


# Calibration
def _iso(where, key="lang"):
    return f"""SELECT {key}, x, max(g) AS y FROM (SELECT i.{key}, i.x, a.a, min(a.m) AS g FROM st i JOIN (
      SELECT p.{key}, p.x AS a, q.x AS b, (q.cy-p.cy+p.y*p.w)/(q.cw-p.cw+p.w) AS m FROM st p JOIN st q ON p.{key}=q.{key} AND q.x>=p.x) a
      ON a.{key}=i.{key} AND a.a<=i.x AND a.b>=i.x GROUP BY ALL) GROUP BY {key}, x"""


def _st(where):
    return f"""SELECT *, sum(y*w) OVER (PARTITION BY lang ORDER BY x) AS cy, sum(w) OVER (PARTITION BY lang ORDER BY x) AS cw FROM (
      SELECT lang, score AS x, avg(label) AS y, count(*)::DOUBLE AS w FROM scores WHERE {where} GROUP BY ALL)"""


_APPLY = """SELECT t.*, CASE WHEN a.x IS NULL THEN b.y WHEN b.x IS NULL THEN a.y ELSE a.y+(b.y-a.y)*(t.score-a.x)/(b.x-a.x) END AS calibrated FROM test t
  ASOF LEFT JOIN iso a ON a.lang=t.lang AND a.x<=t.score ASOF LEFT JOIN iso b ON b.lang=t.lang AND b.x>t.score"""
CAL = {"st": _st("split='train'"), "iso": _iso(""), "test": "SELECT * FROM scores WHERE split='test'", "cal": _APPLY}


@query("isotonic_fit", sql("SELECT lang, x, round(y,6)+0.0 AS y FROM iso", "scores", st=_st("TRUE"), iso=_iso("")))
def _(spark, d):
    return rnd(C.isotonic_fit(V.scores(spark, d), ["lang"], "score", "label"), "y")


@query("isotonic_apply", sql("SELECT doc_id, lang, score, round(calibrated,6)+0.0 AS calibrated FROM cal", "scores", **CAL))
def _(spark, d):
    s = V.scores(spark, d)
    k = C.isotonic_fit(s.where("split = 'train'"), ["lang"], "score", "label")
    return rnd(C.isotonic_apply(s.where("split = 'test'"), k, ["lang"], "score").select("doc_id", "lang", "score", "calibrated"), "calibrated")


_REL = "SELECT lang, least(floor({s}*10),9)::BIGINT AS bin, avg({s}) AS mc, avg(label) AS acc, count(*) AS n FROM {t} GROUP BY ALL"


@query("reliability_table", sql("SELECT lang, bin, round(mc,6) AS mean_confidence, round(acc,6)+0.0 AS accuracy, n AS \"count\" FROM rel", "scores", rel=_REL.format(s="score", t="scores")))
def _(spark, d):
    return rnd(C.reliability_table(V.scores(spark, d), ["lang"], "score", "label"), "mean_confidence", "accuracy")


@query("ece", sql("SELECT lang, round(sum(n*abs(acc-mc))/sum(n),6) AS ece FROM rel GROUP BY lang", "scores", rel=_REL.format(s="score", t="scores")))
def _(spark, d):
    return rnd(C.ece(C.reliability_table(V.scores(spark, d), ["lang"], "score", "label"), ["lang"]), "ece")


@query("calibration_report", sql("""SELECT a.lang, round(a.e,6) AS ece_raw, round(b.e,6) AS ece_calibrated, k.knots FROM (SELECT lang, sum(n*abs(acc-mc))/sum(n) AS e FROM relr GROUP BY lang) a
  LEFT JOIN (SELECT lang, sum(n*abs(acc-mc))/sum(n) AS e FROM relc GROUP BY lang) b USING (lang) JOIN (SELECT lang, count(DISTINCT score) AS knots FROM scores GROUP BY 1) k USING (lang)""",
  "scores", **CAL, relr=_REL.format(s="score", t="test"), relc=_REL.format(s="round(calibrated,9)", t="cal")))
def _(spark, d):
    return rnd(C.calibration_report(V.scores(spark, d), "lang", "score", "label"), "ece_raw", "ece_calibrated")


_PICK = """SELECT gen, CASE WHEN th IS NULL THEN 'inf'::DOUBLE ELSE coalesce((th+(SELECT max(v) FROM tail t WHERE t.gen=p.gen AND t.v<th))/2, th) END AS threshold FROM (
  SELECT gen, min(v) FILTER (n>=8 AND k/n>={p}) AS th FROM tail GROUP BY gen) p"""
_TAIL = """SELECT gen, v, sum(c) OVER w AS n, sum(ok) OVER w AS k FROM (SELECT gen, round({v},6) AS v, count(*) AS c, count(*) FILTER ({ok}) AS ok FROM fl WHERE label IS NOT NULL GROUP BY ALL)
  WINDOW w AS (PARTITION BY gen ORDER BY v DESC)"""


@query("precision_threshold", sql("SELECT gen, round(threshold,6) AS threshold FROM (" + _PICK.format(p=0.5) + ")", "score_rows", fl=FL, tail=_TAIL.format(v="margin", ok="label_ok OR margin>90000")))
def _(spark, d):
    s = M.flags(V.score_rows(spark, d)).where("label IS NOT NULL")
    return rnd(C.precision_threshold(s, ["gen"], "margin", F.col("label_ok") | (F.col("margin") > 90000), precision=0.5), "threshold")


_SPLIT = """SELECT e.*, CASE WHEN protocol IN ('web') THEN 'test' WHEN rn%2=1 THEN 'test' ELSE 'calibration' END AS split FROM (SELECT doc_id AS id, lang AS stratum, source||'-'||(n_chars%17)::VARCHAR AS protocol FROM documents) e
  LEFT JOIN (SELECT stratum, protocol, row_number() OVER (PARTITION BY stratum ORDER BY sha256(protocol), protocol) AS rn FROM (
  SELECT DISTINCT lang AS stratum, source||'-'||(n_chars%17)::VARCHAR AS protocol FROM documents)) USING (stratum, protocol)"""


def _split(spark, d):
    e = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("stratum"),
                                              F.concat("source", F.lit("-"), (F.col("n_chars") % 17).cast("string")).alias("protocol"))
    return C.stratified_split(e, ["web"])


@query("stratified_split", sql("SELECT * FROM sp", sp=_SPLIT))
def _(spark, d):
    return _split(spark, d)


@query("split_digest", sql("""SELECT sha256(string_agg(d,'' ORDER BY g)) AS digest FROM (SELECT k//256 AS g, sha256(string_agg(d,'' ORDER BY k)) AS d FROM (
  SELECT id//256 AS k, sha256(string_agg(id::VARCHAR||':'||split, ',' ORDER BY id, split)) AS d FROM sp GROUP BY 1) GROUP BY 1)""", sp=_SPLIT))
def _(spark, d):
    return C.split_digest(_split(spark, d), "id")
