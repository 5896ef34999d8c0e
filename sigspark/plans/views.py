"""Signal views: the given tables read as captures, and the same views as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import spectra as S
from ..operators.partitioning import runs

# view parameters
FS = 32_000.0
NFFT = 32
HOP = 8
BLOCK = 800
GUARD = 128
FRAMES_PER_CAPTURE = 100
MARGIN_DB = 3.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: each vector is 32 interleaved complex samples; 100 vectors in a row are one capture."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    return e.select(
        F.floor(F.col("vec_id") / FRAMES_PER_CAPTURE).alias("capture_id"),
        ((F.col("vec_id") % FRAMES_PER_CAPTURE) * NFFT).alias("start"),
        F.transform(F.sequence(F.lit(0), F.lit(NFFT - 1)), lambda k: v[2 * k].cast("double")).alias("i"),
        F.transform(F.sequence(F.lit(0), F.lit(NFFT - 1)), lambda k: v[2 * k + 1].cast("double")).alias("q"))


def iq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.samples_from_chunks(chunks(spark, sf_dir))


def loud_windows(spark: SparkSession, sf_dir: str, gap: int, share: float = 1.0) -> DataFrame:
    """Windows of a whole recording: samples above `share` of its mean power, pauses of at most `gap` samples bridged."""
    x = iq(spark, sf_dir).withColumn("_p", F.col("i") * F.col("i") + F.col("q") * F.col("q"))
    m = x.groupBy("capture_id").agg(F.avg("_p").alias("_m"))
    w = runs(x.join(m, "capture_id").where(F.col("_p") > share * F.col("_m")), ["capture_id"], "n", 1024, gap=gap)
    return w.select("capture_id", F.col("start").alias("start_sample"), F.col("end").alias("end_sample"))


def loud_sql(gap: int, share: float = 1.0) -> str:
    return f"""SELECT capture_id, min(n) AS start_sample, max(n)+1 AS end_sample FROM (SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY n) AS g FROM (
  SELECT x.capture_id, n, CASE WHEN n-lag(n) OVER (PARTITION BY x.capture_id ORDER BY n)<={gap + 1} THEN 0 ELSE 1 END AS new FROM iq x
  JOIN (SELECT capture_id, avg(i*i+q*q) AS m FROM iq GROUP BY 1) USING (capture_id) WHERE i*i+q*q>{share}::DOUBLE*m)) GROUP BY capture_id, g"""


#: the longest window of a capture, the first of equal ones
LONGEST = "SELECT * FROM loud QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY end_sample-start_sample DESC, start_sample)=1"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.groupBy("capture_id").agg(F.sum(F.size("i")).alias("n_samples"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.blocks_from_chunks(chunks(spark, sf_dir), BLOCK, GUARD)


def frames(spark: SparkSession, sf_dir: str, margin_db: float = MARGIN_DB) -> DataFrame:
    return S.scan_blocks(blocks(spark, sf_dir), FS, NFFT, HOP, margin_db)


def cells(spark: SparkSession, sf_dir: str, *arrays: str) -> DataFrame:
    return S.cells(frames(spark, sf_dir), *arrays)


def block_psd(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    return S.welch_psd(c, ["capture_id", "block_id", "core_start", "core_end"], 2, F.col("lft") / HOP)


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: one capture per event type, one sample per hour from its first one on, power = sum(value), empty hours are 0."""
    e = table(spark, sf_dir, "events")
    hour = (F.datediff(F.to_date("ts"), F.lit("2024-01-01")) * 24 + F.hour("ts")).cast("long")
    got = e.groupBy(F.col("event_type").alias("capture_id"), hour.alias("n")).agg(F.sum("value").alias("power"))
    span = got.groupBy("capture_id").agg(F.min("n").alias("first"), F.max("n").alias("last"))
    grid = span.select("capture_id", F.explode(F.sequence("first", "last")).alias("n"))
    return grid.join(got, ["capture_id", "n"], "left").withColumn("power", F.coalesce("power", F.lit(0.0)))


def truth_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: the true signals of a capture (the order), their bands and time spans; every other capture has two."""
    o = table(spark, sf_dir, "orders")
    both = F.sequence(F.lit(0).cast("long"), (F.col("o_orderkey") % 2).cast("long"))
    o = o.select("*", F.explode(both).alias("truth_id"))
    c = (F.col("o_totalprice") + F.col("truth_id") * 400.0) % 1000.0
    w = F.col("o_totalprice") % 97.0 + 40.0
    start = F.datediff("o_orderdate", F.lit("1990-01-01")).cast("long")
    return o.select(F.col("o_orderkey").alias("capture_id"), "truth_id", (c - w / 2).alias("lo"), (c + w / 2).alias("hi"),
                    c.alias("centre"), start.alias("start"), (start + 60).alias("end"),
                    F.col("o_orderpriority").alias("kind"))


def detected_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: the detections of a capture. `det` numbers a detection by all its values."""
    return bands_of(table(spark, sf_dir, "lineitem"))


def bands_of(li: DataFrame) -> DataFrame:
    c = F.col("l_extendedprice") % 1000.0
    w = F.col("l_quantity") * 4.0
    start = F.datediff("l_shipdate", F.lit("1990-01-01")).cast("long")
    return li.select(F.col("l_orderkey").alias("capture_id"), F.col("l_linenumber").alias("det"),
                     (c - w / 2).alias("lo"), (c + w / 2).alias("hi"), start.alias("start"),
                     (start + F.col("l_quantity").cast("long")).alias("end"),
                     (F.col("l_extendedprice") / 1e4).alias("excess"), F.col("l_discount").alias("conf"))


# Hypothesis view: expert by line number, label by expert and return flag (fixed values)
EXPERTS = {1: "nrz", 2: "rrc", 3: "lsp", 4: "fsk", 5: "analog", 6: "keyed", 7: "null"}
LABELS = {"nrz": ("BPSK", "QPSK", "8PSK"), "rrc": ("BPSK", "QPSK", "QAM16"), "lsp": ("QPSK", "8PSK", "QAM16"),
          "fsk": ("FSK2", "FSK4", "FSK8"), "analog": ("AM", "FM", "FM"), "keyed": ("ASK2", "FSK2", "ASK2"),
          "null": ("none", "none", "none")}


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    line, flag = F.col("l_linenumber") - min(EXPERTS), F.col("l_returnflag")
    expert = F.get(F.array(*[F.lit(EXPERTS[k]) for k in sorted(EXPERTS)]), line)
    label = F.get(F.array(*[F.lit(lab) for k in sorted(EXPERTS) for lab in LABELS[EXPERTS[k]]]),
                  line * 3 + F.when(flag == "A", 0).when(flag == "N", 1).when(flag == "R", 2))
    return li.select(
        F.col("l_orderkey").alias("candidate"), expert.alias("expert"), label.alias("label"),
        F.when(~expert.isin("analog", "keyed", "null"), F.col("l_quantity") * 100.0).alias("rate"),
        (F.col("l_extendedprice") / 1e4).alias("score"), (F.col("l_tax") + 0.01).alias("residual"),
        (F.col("l_discount") * 2).alias("usage"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders: noise, power, length and rate of each candidate segment."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("candidate"), F.lit(0.02).alias("noise_var"),
                    ((F.col("o_totalprice") % 100.0) / 500.0 + 0.03).alias("total_power"),
                    (F.lit(2000) + F.col("o_custkey") % 3000).alias("n_samples"), F.lit(20000.0).alias("fs"),
                    ((F.col("o_custkey") % 20) / 20.0).alias("inband"), F.col("o_orderstatus").alias("gen"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents x labels: a score rounded to 4 decimals, as confidences are, and its 0/1 outcome."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select(
        "doc_id", "lang", "source", F.round(F.least(F.col("n_chars") / 30000.0, F.lit(1.0)), 4).alias("score"),
        F.col("quality").alias("label"),
        F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"))


# Score-row view: truth labels by brand number, predictions by line number (fixed values)
TRUTHS = ["BPSK", "QPSK", "8PSK", "QAM16", "FSK2", "FSK4", "ASK2", "AM", "FM", "noise", "OFDM", "QAM64"]


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem x part: truth by part, published answer by line. Truth columns are made on the small side, which grows with
    the tables too: it is merged, not broadcast through the driver once per statistic."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    k = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % len(TRUTHS)
    p = p.select("p_partkey", F.col("p_type").alias("kind"), F.array(*[F.lit(t) for t in TRUTHS])[k].alias("truth"),
                 "p_retailprice", "p_size")
    truth = F.col("truth")
    digital = ~truth.isin("AM", "FM", "noise", "OFDM")
    noise = truth == "noise"
    p = p.select(
        "p_partkey", "kind", "truth", F.rtrim(truth, F.lit("0123456789")).alias("truth_family"), digital.alias("digital"),
        F.when(digital, F.col("p_retailprice")).alias("rate_true"), F.col("p_retailprice").alias("price"),
        F.when(~noise, F.col("p_size").cast("double") - 5.0).alias("snr_true"),
        F.when(truth.isin("BPSK", "QPSK", "8PSK", "QAM16", "QAM64", "ASK2"), F.col("p_retailprice") * 0.5).alias("bw3_true"),
        (~truth.isin("noise", "OFDM", "QAM64")).alias("in_library"), truth.isin("OFDM", "QAM64").alias("out_of_library"), noise.alias("_noise"))
    ln, tax = F.col("l_linenumber"), F.col("l_tax")
    pred = (F.when(ln <= 3, F.when(~F.col("_noise"), truth)).when(ln == 4, F.col("truth_family")).when(ln == 5, F.lit("BPSK")))
    rate = F.when(F.col("digital") & (ln <= 5), F.when(tax < 0.03, F.col("price") * (1 + tax))
                  .when(tax < 0.05, F.col("price") * 2.0).when(tax < 0.07, F.col("price") * 1.3))
    bw3 = F.col("bw3_true")
    return li.join(p.hint("merge"), li["l_partkey"] == p["p_partkey"]).select(
        F.col("l_returnflag").alias("gen"), "l_orderkey", ln.alias("line"), "kind", "truth", pred.alias("label"), "rate_true", rate.alias("rate"),
        "snr_true", (F.col("snr_true") + F.col("l_discount") * 40 - 2.0).alias("snr"), F.lit(0.0).alias("fc"), "bw3_true",
        F.when(ln != 7, bw3 * (0.7 + tax * 8)).alias("bw3"), F.when(ln != 6, bw3 * F.col("l_discount") * 1.5).alias("cf"),
        "digital", "in_library", "out_of_library",
        F.when(F.col("_noise"), (ln == 1).cast("int")).otherwise(F.least(ln, F.lit(3)) - (ln == 7).cast("int")).alias("n_det"),
        (~F.col("_noise") & (ln != 7) & (tax < 0.08)).alias("hit"), (F.col("l_quantity") / 60.0).alias("time_s"),
        (F.col("l_discount") == 0.1).alias("claim"), F.col("l_extendedprice").alias("margin"))


_LABEL_SQL = "CASE " + " ".join(
    f"WHEN expert='{e}' AND l_returnflag='{f}' THEN '{lab}'"
    for e, labs in LABELS.items() for f, lab in zip("ANR", labs)) + " END"
_EXPERT_SQL = "CASE l_linenumber " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in EXPERTS.items()) + " END"
_TRUTH_SQL = "[" + ", ".join(f"'{t}'" for t in TRUTHS) + "]"

# name -> (views it reads, body)
CTES: dict[str, tuple[list[str], str]] = {
    "iq": ([], """SELECT vec_id//100 AS capture_id, (vec_id%100)*32 + k AS n,
        embedding[2*k+1]::DOUBLE AS i, embedding[2*k+2]::DOUBLE AS q
        FROM embeddings, (SELECT unnest(range(32)) AS k)"""),
    "caps": (["iq"], "SELECT capture_id, count(*) AS total FROM iq GROUP BY 1"),
    "blocks": (["caps"], """SELECT capture_id, total, b AS block_id, b*800 AS core_start,
        least(total,(b+1)*800) AS core_end, greatest(0,b*800-128) AS lft, least(total,(b+1)*800+128) AS rgt
        FROM (SELECT capture_id, total, unnest(range((total+799)//800)) AS b FROM caps)"""),
    "spec": (["iq", "caps"], """SELECT capture_id, frame, bin, (re*re+im*im)/(32000.0*12.0) AS power FROM (
        SELECT capture_id, frame, bin,
          sum(w*(i*cos(a)+q*sin(a))) AS re, sum(w*(q*cos(a)-i*sin(a))) AS im FROM (
          SELECT f.capture_id, f.frame, b.bin, x.i, x.q, 0.5-0.5*cos(2*pi()*h.k/32) AS w,
            2*pi()*(b.bin-16)*h.k/32 AS a
          FROM (SELECT capture_id, unnest(range((total-32)//8+1)) AS frame FROM caps) f,
            (SELECT unnest(range(32)) AS k) h, (SELECT unnest(range(32)) AS bin) b, iq x
          WHERE x.capture_id=f.capture_id AND x.n=8*f.frame+h.k) GROUP BY 1,2,3)"""),
    "cells": (["spec", "blocks"], """SELECT b.capture_id, b.block_id, b.lft, b.rgt, b.core_start, b.core_end, s.frame,
        s.bin, s.power, (s.frame*8+16 >= b.core_start AND s.frame*8+16 < b.core_end) AS is_core
        FROM blocks b JOIN spec s ON s.capture_id=b.capture_id AND s.frame*8>=b.lft AND s.frame*8+32<=b.rgt"""),
    "psd": (["cells"], """SELECT capture_id, block_id, core_start, core_end, bin, avg(power) AS power FROM cells
        WHERE (frame-lft//8)%2=0 GROUP BY ALL"""),
    "floors": (["psd"], """SELECT capture_id, block_id, core_start, core_end,
        greatest(median(power),1e-30) AS noise_floor FROM psd GROUP BY ALL"""),
    "smooth": (["cells"], """SELECT * EXCLUDE (p1), (coalesce(lag(p1) OVER wb,p1)+p1+coalesce(lead(p1) OVER wb,p1))/3 AS smooth
        FROM (SELECT *, (coalesce(lag(power) OVER wf,power)+power+coalesce(lead(power) OVER wf,power))/3 AS p1 FROM cells
          WINDOW wf AS (PARTITION BY capture_id, block_id, bin ORDER BY frame))
        WINDOW wb AS (PARTITION BY capture_id, block_id, frame ORDER BY bin)"""),
    "mask": (["smooth", "floors"], f"""SELECT s.*, f.noise_floor,
        10*log10(greatest(s.smooth,1e-30)) > 10*log10(f.noise_floor)+{MARGIN_DB} AS above
        FROM smooth s JOIN floors f USING (capture_id, block_id)"""),
    "opened": (["mask", "sq"], """SELECT m.*, EXISTS (SELECT 1 FROM sq WHERE sq.capture_id=m.capture_id AND sq.block_id=m.block_id
          AND sq.frame IN (m.frame, m.frame-1) AND sq.bin IN (m.bin, m.bin-1)) AS hit FROM mask m"""),
    "sq": (["mask"], """SELECT a.capture_id, a.block_id, a.frame, a.bin FROM mask a
        JOIN mask b ON b.capture_id=a.capture_id AND b.block_id=a.block_id AND b.frame=a.frame+1 AND b.bin=a.bin AND b.above
        JOIN mask c ON c.capture_id=a.capture_id AND c.block_id=a.block_id AND c.frame=a.frame AND c.bin=a.bin+1 AND c.above
        JOIN mask d ON d.capture_id=a.capture_id AND d.block_id=a.block_id AND d.frame=a.frame+1 AND d.bin=a.bin+1 AND d.above
        WHERE a.above"""),
    "active": (["opened"], "SELECT capture_id, block_id, bin, count(*) AS n_hit FROM opened WHERE hit GROUP BY ALL"),
    "bands0": (["active"], """SELECT capture_id, block_id, min(bin) AS fa, max(bin)+1 AS fb FROM (
        SELECT *, sum(new) OVER (PARTITION BY capture_id, block_id ORDER BY bin) AS g FROM (
          SELECT *, CASE WHEN bin - lag(bin) OVER (PARTITION BY capture_id, block_id ORDER BY bin) <= 3 THEN 0 ELSE 1 END AS new
          FROM active)) GROUP BY capture_id, block_id, g"""),
    "bands": (["bands0", "opened"], """SELECT b.capture_id, b.block_id, b.fa, b.fb, count(DISTINCT o.frame) AS active_frames,
        count(*) AS hit_cells FROM bands0 b JOIN opened o ON o.capture_id=b.capture_id AND o.block_id=b.block_id
        AND o.bin>=b.fa AND o.bin<b.fb AND o.hit
        WHERE b.fb-b.fa>=2 GROUP BY ALL HAVING count(DISTINCT o.frame)>=3 AND count(*)>=12"""),
    "band_on": (["bands", "opened"], """SELECT DISTINCT b.capture_id, b.block_id, b.fa, b.fb, o.frame FROM bands b JOIN opened o
        ON o.capture_id=b.capture_id AND o.block_id=b.block_id AND o.bin>=b.fa AND o.bin<b.fb AND o.hit"""),
    "band_cells": (["band_on", "opened"], """SELECT b.fa, b.fb, o.* FROM band_on b JOIN opened o
        ON o.capture_id=b.capture_id AND o.block_id=b.block_id AND o.frame=b.frame AND o.bin>=b.fa AND o.bin<b.fb"""),
    "bstat": (["band_cells"], """SELECT capture_id, block_id, fa, fb, count(DISTINCT frame) AS n_on, 10*log10(max(smooth)) AS peak
        FROM band_cells GROUP BY ALL"""),
    "bpairs": (["bstat"], """SELECT * FROM (SELECT *, lead(fa) OVER w AS fa2, lead(fb) OVER w AS fb2, lead(peak) OVER w AS peak2,
        lead(n_on) OVER w AS n_on2, lag(fa) OVER w AS fa0, lag(fb) OVER w AS fb0, lag(peak) OVER w AS peak0, lead(fa,2) OVER w AS fa3,
        lead(fb,2) OVER w AS fb3, lead(peak,2) OVER w AS peak3, lead(fa) OVER w - fb AS gap FROM bstat
        WINDOW w AS (PARTITION BY capture_id, block_id ORDER BY fa)) WHERE fa2 IS NOT NULL"""),
    "bframes": (["bpairs", "band_on"], """SELECT p.capture_id, p.block_id, p.fa, p.fb, p.fa2, p.fb2, o.frame,
        count(*)=2 AS in_both FROM bpairs p JOIN band_on o ON o.capture_id=p.capture_id AND o.block_id=p.block_id AND o.fa IN (p.fa, p.fa2)
        GROUP BY ALL"""),
    "blevels": (["bframes", "cells", "bands"], """SELECT capture_id, block_id, fa, fb, avg(power) FILTER (bin>=fa AND bin<fb) AS lp,
        avg(power) FILTER (bin>=fa2 AND bin<fb2) AS rp, avg(power) FILTER (bin>=fb AND bin<fa2) AS gp,
        median(power) FILTER (near) AS np, count(*) FILTER (near) AS nn FROM (
        SELECT f.capture_id, f.block_id, f.fa, f.fb, f.fa2, f.fb2, c.bin, avg(c.power) AS power,
          (c.bin < greatest(0,f.fa-(f.fb2-f.fa)) OR c.bin >= least(32,f.fb2+(f.fb2-f.fa))) AND NOT EXISTS (SELECT 1 FROM bands o
            WHERE o.capture_id=f.capture_id AND o.block_id=f.block_id AND c.bin>=o.fa AND c.bin<o.fb) AS near
        FROM bframes f JOIN cells c ON c.capture_id=f.capture_id AND c.block_id=f.block_id AND c.frame=f.frame
          AND c.bin>=f.fa-3*(f.fb2-f.fa) AND c.bin<f.fb2+3*(f.fb2-f.fa) GROUP BY ALL) GROUP BY ALL"""),
    "bjoins": (["bpairs", "blevels", "bframes"], """SELECT p.capture_id, p.block_id, p.fa, p.fb, p.fa2, p.fb2, p.gap, s.shared AS shared_frames,
        s.shared>=0.8*least(n_on,n_on2) AS co_timed, s.shared>=0.8*least(n_on,n_on2) AND (gap<=0.25*greatest(p.fb-p.fa,p.fb2-p.fa2)
          OR (abs(peak-peak2)>=6 AND gap<=CASE WHEN peak>=peak2 THEN p.fb-p.fa ELSE p.fb2-p.fa2 END AND NOT coalesce(CASE WHEN peak>=peak2
              THEN peak3-peak2>=6 AND least(abs(fa3-p.fb2),abs(p.fa2-fb3))<=fb3-fa3
              ELSE peak0-peak>=6 AND least(abs(fa0-p.fb),abs(p.fa-fb0))<=fb0-fa0 END,FALSE))
          OR coalesce(gap>0 AND nn>=4 AND 10*log10(greatest(gp,1e-30))-10*log10(greatest(np,1e-30))>=1.5
              AND 10*log10(greatest(least(lp,rp),1e-30))-10*log10(greatest(gp,1e-30))<=10,FALSE)) AS joins
        FROM bpairs p JOIN blevels l USING (capture_id, block_id, fa, fb)
        JOIN (SELECT capture_id, block_id, fa, count(*) FILTER (in_both) AS shared FROM bframes GROUP BY ALL) s USING (capture_id, block_id, fa)"""),
    "merged_parts": (["bands", "bjoins"], """SELECT capture_id, block_id, fa, fb, min(fa) OVER g AS mfa, max(fb) OVER g AS mfb FROM (
        SELECT *, sum(new) OVER (PARTITION BY capture_id, block_id ORDER BY fa) AS g FROM (
          SELECT b.*, CASE WHEN lag(joins) OVER (PARTITION BY b.capture_id, b.block_id ORDER BY b.fa) THEN 0 ELSE 1 END AS new
          FROM bands b LEFT JOIN bjoins j USING (capture_id, block_id, fa)))
        WINDOW g AS (PARTITION BY capture_id, block_id, g)"""),
    "merged_cells": (["merged_parts", "opened"], """SELECT m.mfa AS fa, m.mfb AS fb, o.*, EXISTS (SELECT 1 FROM merged_parts p
          WHERE p.capture_id=o.capture_id AND p.block_id=o.block_id AND p.mfa=m.mfa AND o.bin>=p.fa AND o.bin<p.fb) AS used
        FROM (SELECT DISTINCT p.capture_id, p.block_id, p.mfa, p.mfb, h.frame FROM merged_parts p JOIN opened h
          ON h.capture_id=p.capture_id AND h.block_id=p.block_id AND h.bin>=p.fa AND h.bin<p.fb AND h.hit) m
        JOIN opened o ON o.capture_id=m.capture_id AND o.block_id=m.block_id AND o.frame=m.frame AND o.bin>=m.mfa AND o.bin<m.mfb"""),
    "ticks": ([], """SELECT g.capture_id, g.n, coalesce(e.power,0.0) AS power FROM (
        SELECT capture_id, unnest(range(first,last+1)) AS n FROM (SELECT event_type AS capture_id,
          min(datediff('hour', TIMESTAMP '2024-01-01', date_trunc('hour',ts))) AS first, max(datediff('hour', TIMESTAMP '2024-01-01', date_trunc('hour',ts))) AS last FROM events GROUP BY 1)) g
        LEFT JOIN (SELECT event_type AS capture_id, datediff('hour', TIMESTAMP '2024-01-01', date_trunc('hour',ts)) AS n,
          sum(value) AS power FROM events GROUP BY ALL) e USING (capture_id, n)"""),
    "truth_bands": ([], """SELECT o_orderkey AS capture_id, truth_id, c-w/2 AS lo, c+w/2 AS hi, c AS centre, s AS start, s+60 AS "end",
        o_orderpriority AS kind FROM (SELECT *, (o_totalprice+truth_id*400.0::DOUBLE)%1000.0::DOUBLE AS c, o_totalprice%97.0::DOUBLE+40.0 AS w,
        datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS s FROM (SELECT *, unnest(range(o_orderkey%2+1)) AS truth_id FROM orders))"""),
    "detected_bands": ([], """SELECT l_orderkey AS capture_id, l_linenumber AS det, c-w/2 AS lo, c+w/2 AS hi, s AS start,
        s+l_quantity::BIGINT AS "end", l_extendedprice/1e4 AS excess, l_discount AS conf FROM (
        SELECT *, l_extendedprice%1000.0::DOUBLE AS c, l_quantity*4.0 AS w,
        datediff('day', DATE '1990-01-01', l_shipdate::DATE) AS s FROM lineitem)"""),
    "hyps": ([], f"""SELECT l_orderkey AS candidate, expert, {_LABEL_SQL} AS label,
        CASE WHEN expert NOT IN ('analog','keyed','null') THEN l_quantity*100.0 END AS rate,
        l_extendedprice/1e4 AS score, l_tax+0.01 AS residual, l_discount*2 AS usage
        FROM (SELECT *, {_EXPERT_SQL} AS expert FROM lineitem)"""),
    "candidates": ([], """SELECT o_orderkey AS candidate, 0.02::DOUBLE AS noise_var,
        (o_totalprice%100.0::DOUBLE)/500.0+0.03 AS total_power, 2000+o_custkey%3000 AS n_samples, 20000.0::DOUBLE AS fs,
        (o_custkey%20)/20.0::DOUBLE AS inband, o_orderstatus AS gen FROM orders"""),
    "scores": ([], """SELECT doc_id, lang, source, round(least(n_chars/30000.0::DOUBLE,1.0),4) AS score, quality AS label,
        CASE WHEN doc_id%2=0 THEN 'train' ELSE 'test' END AS split FROM documents JOIN labels USING (doc_id)"""),
    "score_rows": ([], f"""SELECT l_returnflag AS gen, l_orderkey, ln AS line, p_type AS kind, truth,
        CASE WHEN ln<=3 THEN CASE WHEN truth<>'noise' THEN truth END WHEN ln=4 THEN regexp_replace(truth,'\\d+$','')
          WHEN ln=5 THEN 'BPSK' END AS label,
        CASE WHEN digital THEN p_retailprice END AS rate_true,
        CASE WHEN digital AND ln<=5 THEN CASE WHEN l_tax<0.03 THEN p_retailprice*(1+l_tax) WHEN l_tax<0.05 THEN p_retailprice*2.0
          WHEN l_tax<0.07 THEN p_retailprice*1.3 END END AS rate,
        snr_true, snr_true+l_discount*40-2.0 AS snr, 0.0::DOUBLE AS fc, bw3_true,
        CASE WHEN ln<>7 THEN bw3_true*(0.7+l_tax*8) END AS bw3, CASE WHEN ln<>6 THEN bw3_true*l_discount*1.5 END AS cf,
        digital, truth NOT IN ('noise','OFDM','QAM64') AS in_library, truth IN ('OFDM','QAM64') AS out_of_library,
        CASE WHEN truth='noise' THEN (ln=1)::INT ELSE least(ln,3)-(ln=7)::INT END AS n_det,
        truth<>'noise' AND ln<>7 AND l_tax<0.08 AS hit, l_quantity/60.0 AS time_s, l_discount=0.1 AS claim,
        l_extendedprice AS margin FROM (
        SELECT *, CASE WHEN truth IN ('BPSK','QPSK','8PSK','QAM16','QAM64','ASK2') THEN p_retailprice*0.5 END AS bw3_true,
          CASE WHEN truth<>'noise' THEN p_size::DOUBLE-5.0 END AS snr_true,
          truth NOT IN ('AM','FM','noise','OFDM') AS digital FROM (
          SELECT *, l_linenumber AS ln, ({_TRUTH_SQL})[regexp_extract(p_brand,'(\\d+)$',1)::INT % {len(TRUTHS)} + 1] AS truth
          FROM lineitem JOIN part ON l_partkey=p_partkey))"""),
}


def sql(body: str, *uses: str, **extra: str) -> str:
    """`body` over the views it names, each written once, in dependency order. `extra` adds local views."""
    order: list[str] = []

    def visit(name: str):
        for d in CTES[name][0]:
            visit(d)
        if name not in order:
            order.append(name)
    for u in uses:
        visit(u)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({b})" for n, b in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# The walk of a capture spelled out: one step per detection, the list of tracks as its state. A track last seen in the block
# before is one that is open and not taken in this block
WALK_SQL = """SELECT o.capture_id, 0 AS k, CAST([] AS STRUCT(lo DOUBLE, hi DOUBLE, seen BIGINT)[]) AS tracks, CAST(NULL AS BIGINT) AS took FROM ordered o WHERE o.k = 1
 UNION ALL SELECT capture_id, k, CASE WHEN hit IS NULL THEN list_append(tracks, struct_pack(lo := lo, hi := hi, seen := block))
   ELSE list_transform(tracks, lambda t, i: CASE WHEN i = hit THEN struct_pack(lo := least(t.lo, lo), hi := greatest(t.hi, hi), seen := block) ELSE t END) END,
   CAST(coalesce(hit - 1, len(tracks)) AS BIGINT)
 FROM (SELECT w.capture_id, o.k, o.block, o.lo, o.hi, w.tracks, list_position(list_transform(w.tracks, lambda t: t.seen = o.block - 1
   AND least(t.hi, o.hi) - greatest(t.lo, o.lo) >= 0.5 * least(t.hi - t.lo, o.hi - o.lo)), true) AS hit
   FROM walk w JOIN ordered o ON o.capture_id = w.capture_id AND o.k = w.k + 1)"""
ORDERED_SQL = "SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY block, lo, hi, det, excess) AS k FROM tdet"


def recursive(text: str) -> str:
    """A statement whose view `walk` refers to itself."""
    return text.replace("WITH ", "WITH RECURSIVE ", 1).replace("walk AS MATERIALIZED", "walk AS")
