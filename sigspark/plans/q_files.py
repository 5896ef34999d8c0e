"""Registered queries: sample codes, catalogs, pairing, outputs, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import r
from ..functions.text import calibration_claim
from ..sources import catalog as CA, sinks as SK
from ..sources.iq import normalize_codes
from . import views as V
from .registry import query
from .views import sql


def rnd(df, *cols, digits=6):
    return df.withColumns({c: r(F.col(c), digits) for c in cols})


@query("normalize_codes", """SELECT event_id, datatype, round(CASE WHEN datatype='ci16_le' THEN code/32768.0 WHEN datatype='ci8' THEN code/128.0 WHEN datatype='cu8' THEN (code-127.5)/127.5 ELSE code END,9)+0.0 AS sample FROM (
  SELECT event_id, CASE event_id%4 WHEN 0 THEN 'ci16_le' WHEN 1 THEN 'ci8' WHEN 2 THEN 'cu8' ELSE 'cf32_le' END AS datatype, CASE event_id%4 WHEN 0 THEN (event_id*37)%65536-32768 WHEN 1 THEN (event_id*37)%256-128 WHEN 2 THEN (event_id*37)%256 ELSE value END::DOUBLE AS code FROM events)""")
def _(spark, d):
    e, m = V.table(spark, d, "events"), F.col("event_id") % 4
    k = F.col("event_id") * 37
    e = e.select("event_id", F.when(m == 0, "ci16_le").when(m == 1, "ci8").when(m == 2, "cu8").otherwise("cf32_le").alias("datatype"),
                 F.when(m == 0, k % 65536 - 32768).when(m == 1, k % 256 - 128).when(m == 2, k % 256).otherwise(F.col("value")).cast("double").alias("code"))
    return normalize_codes(e, "code", "datatype").select("event_id", "datatype", r(F.col("sample"), 9).alias("sample"))


_META = """'{"global":{"core:datatype":"'||CASE event_id%2 WHEN 0 THEN 'cf32_le' ELSE 'ci16_le' END||'","core:sample_rate":'||CASE event_id%7 WHEN 0 THEN 0 ELSE user_id*1000 END||',"core:num_channels":'||CASE event_id%11 WHEN 0 THEN 2 ELSE 1 END||
  '},"captures":[{"core:sample_start":0,"core:frequency":'||(event_id%5)*1000||'}'||CASE event_id%13 WHEN 0 THEN ',{"core:sample_start":9,"core:frequency":7}' ELSE '' END||']}'"""


def _meta(spark, d):
    c = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    i = F.col("event_id")
    t = c('{"global":{"core:datatype":"', F.when(i % 2 == 0, "cf32_le").otherwise("ci16_le"), '","core:sample_rate":',
          F.when(i % 7 == 0, F.lit("0")).otherwise((F.col("user_id") * 1000).cast("string")), ',"core:num_channels":', F.when(i % 11 == 0, "2").otherwise("1"),
          '},"captures":[{"core:sample_start":0,"core:frequency":', (i % 5 * 1000).cast("string"), "}",
          F.when(i % 13 == 0, ',{"core:sample_start":9,"core:frequency":7}').otherwise(""), "]}")
    return V.table(spark, d, "events").select("event_id", t.alias("meta"))


@query("capture_catalog", """SELECT event_id, CASE event_id%2 WHEN 0 THEN 'cf32_le' ELSE 'ci16_le' END AS datatype, rt AS sample_rate, ((event_id%5)*1000)::DOUBLE AS center_frequency_hz,
  CASE WHEN rt<=0 THEN 'metadata must specify a positive sample rate' WHEN event_id%13=0 OR event_id%11=0 THEN 'retuned or multi-channel captures are not supported' END AS reject
  FROM (SELECT *, CASE event_id%7 WHEN 0 THEN 0 ELSE user_id*1000 END::DOUBLE AS rt FROM events)""")
def _(spark, d):
    return CA.parse_catalog(_meta(spark, d), "meta").drop("meta")


_NAME = "event_type||event_id||CASE event_id%3 WHEN 0 THEN '_'||(user_id%900)||'.5M_'||(event_id%500+1)||'k' ELSE '' END||CASE event_id%4 WHEN 0 THEN '.cu8' WHEN 1 THEN '.CS16' WHEN 2 THEN '.cs8' ELSE '.iq' END"


def _names(spark, d):
    i = F.col("event_id")
    mid = F.when(i % 3 == 0, F.concat(F.lit("_"), (F.col("user_id") % 900).cast("string"), F.lit(".5M_"), (i % 500 + 1).cast("string"), F.lit("k"))).otherwise("")
    ext = F.when(i % 4 == 0, ".cu8").when(i % 4 == 1, ".CS16").when(i % 4 == 2, ".cs8").otherwise(".iq")
    return V.table(spark, d, "events").select("event_id", "user_id", F.concat("event_type", i.cast("string"), mid, ext).alias("name"))


@query("filename_hints", f"""SELECT event_id, {_NAME} AS name, CASE event_id%4 WHEN 0 THEN 'cu8' WHEN 1 THEN 'ci16_le' WHEN 2 THEN 'ci8' END AS datatype,
  CASE WHEN event_id%3=0 AND event_id%4<>3 THEN (event_id%500+1)*1000.0::DOUBLE END AS sample_rate, CASE WHEN event_id%3=0 AND event_id%4<>3 THEN (user_id%900+0.5)*1e6 END AS center_frequency_hz FROM events""")
def _(spark, d):
    n = _names(spark, d)
    return n.select("event_id", "name", *[c.alias(k) for k, c in CA.filename_hints(F.col("name")).items()])


@query("pair_sidecars", """SELECT 'cap'||o_orderkey||'.sigmf-data' AS name, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey) AS paired,
  CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey) THEN 'missing cap'||o_orderkey||'.sigmf-meta next to cap'||o_orderkey||'.sigmf-data' END AS error FROM orders""")
def _(spark, d):
    data = V.table(spark, d, "orders").select(F.concat(F.lit("cap"), F.col("o_orderkey").cast("string"), F.lit(".sigmf-data")).alias("name"))
    meta = V.table(spark, d, "lineitem").select(F.concat(F.lit("cap"), F.col("l_orderkey").cast("string"), F.lit(".sigmf-meta")).alias("name")).distinct()
    pairs, errors = CA.pair_sidecars(data, meta)
    return pairs.select("name", F.lit(True).alias("paired"), F.lit(None).cast("string").alias("error")).unionByName(
        errors.select("name", F.lit(False).alias("paired"), "error"))


_DECL = """SELECT event_id, CASE event_id%4 WHEN 0 THEN 8000.0 WHEN 1 THEN 9000.0 END::DOUBLE AS given_rate, CASE WHEN event_id%3=0 THEN 8000.0 END::DOUBLE AS meta_rate, CASE WHEN event_id%5<>0 THEN 7000.0 END::DOUBLE AS hint_rate,
  CASE WHEN event_id%6=1 THEN 'cu8' END AS given_type, CASE WHEN event_id%3=0 THEN 'cf32_le' END AS meta_type, CASE WHEN event_id%7<>0 THEN 'cu8' END AS hint_type FROM events"""


@query("resolve_declared", f"""SELECT event_id, coalesce(meta_rate,given_rate,hint_rate) AS rate, coalesce(meta_type,given_type,hint_type) AS datatype, error, CASE WHEN error IS NULL THEN CASE WHEN meta_rate IS NOT NULL THEN 'metadata'
  WHEN coalesce(given_rate,hint_rate)=hint_rate OR coalesce(given_type,hint_type)=hint_type THEN 'file name' ELSE 'declared' END END AS origin FROM (SELECT *, CASE WHEN given_rate<>meta_rate THEN 'Provided sample rate conflicts with metadata.'
  WHEN given_type<>meta_type THEN 'Provided datatype conflicts with metadata.' WHEN coalesce(meta_rate,given_rate,hint_rate) IS NULL OR coalesce(meta_type,given_type,hint_type) IS NULL THEN '{CA.AMBIGUOUS}' END AS error FROM ({_DECL}))""")
def _(spark, d):
    i = F.col("event_id")
    e = V.table(spark, d, "events").select(
        "event_id", F.when(i % 4 == 0, 8000.0).when(i % 4 == 1, 9000.0).alias("given_rate"), F.when(i % 3 == 0, 8000.0).alias("meta_rate"), F.when(i % 5 != 0, 7000.0).alias("hint_rate"),
        F.when(i % 6 == 1, "cu8").alias("given_type"), F.when(i % 3 == 0, "cf32_le").alias("meta_type"), F.when(i % 7 != 0, "cu8").alias("hint_type"))
    return CA.resolve_declared(e).select("event_id", "rate", "datatype", "error", "origin")


@query("lock_files", """SELECT coalesce(a.id,b.id) AS id, coalesce(b.digest,a.digest) AS digest, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'absent' WHEN a.digest<>b.digest THEN 'changed' ELSE 'same' END AS state
  FROM (SELECT doc_id AS id, sha256(text) AS digest FROM documents WHERE doc_id%10<>9) a FULL JOIN (SELECT doc_id AS id, CASE WHEN doc_id%17=0 THEN sha256(lang) ELSE sha256(text) END AS digest FROM documents WHERE doc_id%4<>0) b ON a.id=b.id""")
def _(spark, d):
    t = V.table(spark, d, "documents")
    cur = t.where("doc_id % 10 <> 9").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    lock = t.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 17 == 0, F.col("lang")).otherwise(F.col("text")).cast("binary"), 256).alias("digest"))
    return CA.lock_files(cur, lock)


@query("sanitize_annotations", """SELECT event_id, ((event_id%97)+50<=100)::INT+((event_id%61)+10<=100)::INT AS kept, CASE WHEN event_id%2=0 THEN '2024' END AS "when" FROM events""")
def _(spark, d):
    i = F.col("event_id")
    t = F.format_string('{"global":{"core:datatype":"cu8","core:sha512":"ab"},"captures":[{"core:sample_start":0%s}],"annotations":[{"core:sample_start":%d,"core:sample_count":50},{"core:sample_start":%d,"core:sample_count":10}]}',
                        F.when(i % 2 == 0, ',"core::datetime":"2024"').otherwise(""), i % 97, i % 61)
    e = V.table(spark, d, "events").select("event_id", t.alias("m"))
    s = CA.sanitize_annotations(e, "m", F.lit(100))
    return s.select("event_id", F.size("annotations").alias("kept"), F.col("captures")[0]["core:datetime"].alias("when"))


# Outputs: detections of the band view, one file per capture
_DET = """SELECT 'cap'||capture_id AS file, capture_id, det AS id, start AS start_sample, "end" AS end_sample, lo AS freq_lower_hz, hi AS freq_upper_hz, excess*0.33333317 AS confidence, 'adaptive_threshold' AS detection_method, det=3 AS is_pulsed,
  conf<0.02 AS needs_review, CASE WHEN det<3 THEN 'BPSK' END AS modulation_label, CASE WHEN det%2=0 THEN 1e6*excess/7.0000013 END AS symbol_rate_hz, CASE WHEN det<>5 THEN excess*3.3333317e-6 END AS snr_db FROM detected_bands"""


def _det(spark, d):
    b, n = V.detected_bands(spark, d), F.col("det")
    return b.select(F.concat(F.lit("cap"), F.col("capture_id").cast("string")).alias("file"), "capture_id", n.alias("id"), F.col("start").alias("start_sample"), F.col("end").alias("end_sample"),
                    F.col("lo").alias("freq_lower_hz"), F.col("hi").alias("freq_upper_hz"), (F.col("excess") * 0.33333317).alias("confidence"), F.lit("adaptive_threshold").alias("detection_method"),
                    (n == 3).alias("is_pulsed"), (F.col("conf") < 0.02).alias("needs_review"), F.when(n < 3, "BPSK").alias("modulation_label"),
                    F.when(n % 2 == 0, 1e6 * F.col("excess") / 7.0000013).alias("symbol_rate_hz"), F.when(n != 5, F.col("excess") * 3.3333317e-6).alias("snr_db"))


@query("detection_documents", sql("SELECT 'cap'||o_orderkey AS file, coalesce(n,0)::INTEGER AS n, first_id FROM orders LEFT JOIN (SELECT file, count(*) AS n, min(id) AS first_id FROM det GROUP BY 1) ON file='cap'||o_orderkey", "detected_bands", det=_DET))
def _(spark, d):
    caps = V.table(spark, d, "orders").select(F.concat(F.lit("cap"), F.col("o_orderkey").cast("string")).alias("file"))
    x = SK.detection_documents(_det(spark, d).select("file", "id", "start_sample", "confidence"), caps)
    return x.select("file", F.size("detections").alias("n"), F.get("detections", F.lit(0))["id"].alias("first_id"))


@query("jsonl_rows", sql("""SELECT '{"file":"'||file||'","end_sample":'||end_sample||',"id":'||id||',"start_sample":'||start_sample||'}' AS value FROM det""", "detected_bands", det=_DET))
def _(spark, d):
    return SK.jsonl_rows(_det(spark, d).select("file", "id", "start_sample", "end_sample"))


@query("summary_rows", sql("""SELECT 'true' AS needs_review, file, id::VARCHAR AS detection_id, coalesce(modulation_label,'') AS label, '' AS tier, coalesce(format('{:.6g}',symbol_rate_hz),'') AS symbol_rate_hz, '' AS center_frequency_hz,
  coalesce(format('{:.6g}',confidence),'') AS bandwidth_3db_hz, coalesce(format('{:.6g}',snr_db),'') AS snr_db, format('{:.6g}',freq_lower_hz/3) AS freq_lower_hz, format('{:.6g}',freq_upper_hz/3) AS freq_upper_hz,
  start_sample::VARCHAR AS start_sample, end_sample::VARCHAR AS end_sample, '' AS status, '' AS error FROM det WHERE needs_review OR id=1 UNION ALL
  SELECT CASE WHEN needs_review THEN 'true' ELSE 'false' END, file, id::VARCHAR, coalesce(modulation_label,''), '', coalesce(format('{:.6g}',symbol_rate_hz),''), '', coalesce(format('{:.6g}',confidence),''), coalesce(format('{:.6g}',snr_db),''),
  format('{:.6g}',freq_lower_hz/3), format('{:.6g}',freq_upper_hz/3), start_sample::VARCHAR, end_sample::VARCHAR, '', '' FROM det WHERE NOT (needs_review OR id=1)
  UNION ALL SELECT 'true', 'doc'||doc_id, '', '', '', '', '', '', '', '', '', '', '', '', 'ValueError: short' FROM documents WHERE n_chars<100""", "detected_bands", det=_DET))
def _(spark, d):
    none = lambda t: F.lit(None).cast(t)
    x = _det(spark, d).withColumns({"label_needs_review": F.col("id") == 1, "estimate_tier": none("string"), "center_frequency_hz": none("double"), "center_frequency_refined_hz": none("double"),
                                    "bandwidth_3db_hz": F.col("confidence"), "verify_status": none("string"), "freq_lower_hz": F.col("freq_lower_hz") / 3, "freq_upper_hz": F.col("freq_upper_hz") / 3})
    err = V.table(spark, d, "documents").where("n_chars < 100").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("file"), F.lit("ValueError: short").alias("error"))
    return SK.summary_rows(x, err)


@query("sigmf_annotations", sql("""SELECT file, count(*) AS n, min(end_sample-start_sample) AS shortest, round(min(freq_lower_hz+CASE WHEN capture_id%3=0 THEN 1e6 ELSE 0 END),4)+0.0 AS lowest, max('Candidate '||id) AS last_label,
  max('{"confidence":'||round(confidence,2)||',"detection_method":"adaptive_threshold","is_pulsed":'||is_pulsed||',"needs_review":'||needs_review||'}') AS last_comment FROM det GROUP BY file, capture_id""".replace("SELECT file, count", "SELECT file, count"), "detected_bands", det=_DET))
def _(spark, d):
    x = _det(spark, d).withColumn("tuning_hz", F.when(F.col("capture_id") % 3 == 0, F.lit(1e6))).withColumn("confidence", F.round("confidence", 2))
    a = SK.sigmf_annotations(x).select("file", F.explode("annotations").alias("a"))
    return a.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("a.core:sample_count").alias("shortest"), r(F.min("a.core:freq_lower_edge"), 4).alias("lowest"),
                                 F.max("a.core:label").alias("last_label"), F.max("a.core:comment").alias("last_comment"))


@query("validate_annotations", sql("""SELECT file, count(*) AS n_annotations, count(*) FILTER (start_sample-3000<0 OR end_sample-start_sample-2<0) AS n_bad, CASE WHEN count(*) FILTER (start_sample-3000<0 OR end_sample-start_sample-2<0)=0 THEN 'OK' ELSE 'invalid' END AS status FROM det GROUP BY file""", "detected_bands", det=_DET))
def _(spark, d):
    x = _det(spark, d).withColumns({"tuning_hz": F.lit(None).cast("double"), "start_sample": F.col("start_sample") - 3000, "end_sample": F.col("end_sample") - 3002})
    return SK.validate_annotations(SK.sigmf_annotations(x))


@query("detections_csv", sql("""SELECT capture_id, id, start_sample, end_sample, printf('%.6f',start_sample/30000.0::DOUBLE) AS start_time_s, printf('%.6f',end_sample/30000.0::DOUBLE) AS end_time_s, printf('%.6f',end_sample/30000.0::DOUBLE-start_sample/30000.0::DOUBLE) AS duration_s,
  printf('%.1f',(freq_lower_hz+freq_upper_hz)/2) AS center_freq_hz, printf('%.1f',freq_upper_hz-freq_lower_hz) AS bandwidth_hz FROM (SELECT * REPLACE (freq_lower_hz*7+0.013 AS freq_lower_hz, freq_upper_hz*7+0.013 AS freq_upper_hz) FROM det)""", "detected_bands", det=_DET))
def _(spark, d):
    x = _det(spark, d).withColumns({"pulse_width_samples": F.lit(None).cast("long"), "pri_samples": F.lit(None).cast("long"),
                                    "freq_lower_hz": F.col("freq_lower_hz") * 7 + 0.013, "freq_upper_hz": F.col("freq_upper_hz") * 7 + 0.013, "id": F.struct("id", "capture_id")})
    c = SK.detections_csv(x, F.lit(30000.0))
    return c.select(F.col("id.capture_id").alias("capture_id"), F.col("id.id").alias("id"), "start_sample", "end_sample", "start_time_s", "end_time_s", "duration_s", "center_freq_hz", "bandwidth_hz")


@query("filter_confidence", sql("SELECT capture_id, id, confidence FROM det WHERE confidence>=1.5", "detected_bands", det=_DET))
def _(spark, d):
    return SK.filter_confidence(_det(spark, d), 1.5).select("capture_id", "id", "confidence")


@query("review_only", sql("SELECT capture_id, id, confidence FROM det WHERE needs_review", "detected_bands", det=_DET))
def _(spark, d):
    return SK.review_only(_det(spark, d)).select("capture_id", "id", "confidence")


@query("sort_detections", sql("SELECT capture_id, id, confidence FROM det ORDER BY confidence DESC, capture_id, id", "detected_bands", det=_DET))
def _(spark, d):
    return SK.sort_detections(_det(spark, d), "confidence", True, ("capture_id", "id")).select("capture_id", "id", "confidence")


@query("calibration_claim", """SELECT doc_id, contains(regexp_replace(lower(t),'not a calibrated|not calibrated|uncalibrated','','g'),'calibrated') AS claim FROM (
  SELECT doc_id, text||CASE doc_id%4 WHEN 0 THEN ' Calibrated score' WHEN 1 THEN ' uncalibrated' WHEN 2 THEN ' not a calibrated probability' ELSE '' END AS t FROM documents)""")
def _(spark, d):
    m = F.col("doc_id") % 4
    tail = F.when(m == 0, " Calibrated score").when(m == 1, " uncalibrated").when(m == 2, " not a calibrated probability").otherwise("")
    return V.table(spark, d, "documents").select("doc_id", calibration_claim(F.concat("text", tail)).alias("claim"))
