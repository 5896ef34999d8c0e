"""Registered queries that run as streams over the events table and read their sink back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import r
from ..session import shared_folder
from ..streaming import jobs as J
from .q_pulses import ASSOCIATE_SQL, tdet
from .registry import query
from .views import sql


def _events(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return e.select("event_id", F.timestamp_micros(us).alias("ts"), F.col("event_type").alias("capture_id"), "user_id", "value")


def _run(spark, stream):
    return J.run_to_end(stream, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


def _span(df, w):
    return df.withColumns({"start_us": F.unix_micros(f"{w}.start"), "end_us": F.unix_micros(f"{w}.end")}).drop(w)


@query("stream_block_psd", sql("""SELECT capture_id, bin, b AS start_us, b+21600000000 AS end_us, round(avg(value),6) AS power, count(*) AS n_frames FROM (SELECT event_type AS capture_id, user_id%8 AS bin, value,
  epoch_us(ts)//21600000000*21600000000 AS b FROM events) GROUP BY ALL"""))
def _(spark, d):
    s = _events(spark, d).select("ts", "capture_id", (F.col("user_id") % 8).alias("bin"), F.col("value").alias("power"))
    x = _run(spark, J.stream_block_psd(s, "ts", "6 hours", "1 hour", ["capture_id"]))
    return _span(x, "window").withColumn("power", r(F.col("power")))


@query("stream_frames", sql("""SELECT capture_id, b AS start_us, b+7200000000 AS end_us, count(*) AS n_samples, round(avg(value),6) AS mean_power, max(value) AS peak FROM (SELECT event_type AS capture_id, value,
  epoch_us(ts)//1800000000*1800000000-unnest([0,1,2,3]::BIGINT[])*1800000000 AS b FROM events) GROUP BY ALL"""))
def _(spark, d):
    x = _run(spark, J.stream_frames(_events(spark, d), "ts", "2 hours", "30 minutes", "1 hour", ["capture_id"], "value"))
    return _span(x, "window").withColumn("mean_power", r(F.col("mean_power")))


@query("stream_packets", sql("""SELECT capture_id, min(u) AS start_us, max(u)+1800000000 AS end_us, count(*) AS n_active, round(sum(value),6) AS energy FROM (SELECT *, sum(new) OVER (PARTITION BY capture_id ORDER BY u) AS g FROM (
  SELECT event_type AS capture_id, value, epoch_us(ts) AS u, CASE WHEN epoch_us(ts)-lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts)<1800000000 THEN 0 ELSE 1 END AS new FROM events WHERE value>40))
  GROUP BY capture_id, g"""))
def _(spark, d):
    x = _run(spark, J.stream_packets(_events(spark, d).where("value > 40"), "ts", "30 minutes", "1 hour", ["capture_id"], "value"))
    return _span(x, "session_window").withColumn("energy", r(F.col("energy")))


def _lineitem(spark, d):
    return spark.readStream.schema(spark.read.parquet(f"{d}/lineitem.parquet").schema).parquet(f"{d}/lineite[m].parquet")


def _append(spark, stream):
    return J.run_to_table(stream, f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


@query("stream_tracks", ASSOCIATE_SQL)
def _(spark, d):
    x = tdet(_lineitem(spark, d)).select("capture_id", "block", "det", "lo", "hi", "excess")
    return _append(spark, J.stream_tracks(x)).select("capture_id", "block", "det", "track")


# events as a listing: ten polls in a row see one file, whose size is the last bit of the value's whole part
@query("stable_files", """SELECT (event_id//10)::VARCHAR AS path, size, event_id%10 AS poll FROM (SELECT event_id, floor(value)::BIGINT%2 AS size,
  lag(floor(value)::BIGINT%2) OVER w AS was, lag(event_id) OVER w AS before FROM events WINDOW w AS (PARTITION BY event_id//10 ORDER BY event_id))
  WHERE was=size AND before=event_id-1 QUALIFY row_number() OVER (PARTITION BY event_id//10 ORDER BY event_id)=1""")
def _(spark, d):
    e = _events(spark, d)
    x = e.select(F.floor(F.col("event_id") / 10).cast("string").alias("path"), (F.floor("value") % 2).alias("size"), (F.col("event_id") % 10).alias("poll"))
    return _append(spark, J.stable_files(x))
