"""Track numbering against a plain loop, and streams against batch."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import tracks as T
from sigspark.streaming import jobs as J

SCHEMA = "capture_id long, block long, det int, lo double, hi double, excess double"


@pytest.fixture(scope="module")
def det():
    r = np.random.default_rng(7)
    rows = []
    for c in range(4):
        for b in range(40 if c == 0 else 8):
            lo = np.sort(r.choice(np.arange(0, 40), r.integers(0, 5), replace=False)) * 10.0
            rows += [(c, b, k, float(v), float(v + r.integers(5, 30)), float(r.random())) for k, v in enumerate(lo)]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def plain(det):
    """First unused track of the previous block that overlaps half the narrower band, its band growing."""
    out = {}
    for c, g in det.groupby("capture_id"):
        tracks = []
        for row in g.sort_values(["block", "lo", "hi", "det", "excess"]).itertuples():
            for t in tracks:
                if t["last"] == row.block - 1 and min(t["hi"], row.hi) - max(t["lo"], row.lo) >= 0.5 * min(t["hi"] - t["lo"], row.hi - row.lo):
                    t.update(lo=min(t["lo"], row.lo), hi=max(t["hi"], row.hi), last=row.block)
                    break
            else:
                t = dict(lo=row.lo, hi=row.hi, last=row.block, id=len(tracks))
                tracks.append(t)
            out[c, row.block, row.det] = t["id"]
    return out


def test_tracks_match_plain_loop(spark, det):
    got = T.associate_tracks(spark.createDataFrame(det, SCHEMA)).collect()
    assert {(r.capture_id, r.block, r.det): r.track for r in got} == plain(det)


def test_tracks_of_a_hot_capture_do_not_depend_on_partitions(spark):
    """One capture has most rows, with bands that meet in groups, blocks without detections, and equal bands."""
    r = np.random.default_rng(3)
    rows = []
    for b in range(2500):
        if b % 97 == 0:
            continue
        for k, g in enumerate(sorted(r.choice(30, 4, replace=False))):
            lo = float(g * 100 + r.integers(0, 60))
            rows.append((0, b, k, lo, lo + float(r.integers(0, 45)), 1.0))
        rows.append((0, b, 9, *rows[-1][3:5], 1.0))
    rows += [(c, b, 0, 0.0, 50.0, 1.0) for c in range(1, 60) for b in range(40)]
    det = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    df = spark.createDataFrame(det, SCHEMA)
    pieces = T.track_pieces(df, 128.0).where("capture_id = 0").groupBy("_segment", "_group").count().collect()
    assert len({p._segment for p in pieces}) == 26 and len(pieces) > 300 and max(p["count"] for p in pieces) < len(det) / 20
    got = []
    for n in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got.append({(x.capture_id, x.block, x.det): x.track for x in T.associate_tracks(df.repartition(int(n)), 128.0).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1] == plain(det)


def run(stream, folder, **kw):
    return J.run_to_table(stream, str(folder))


def test_stream_tracks_equal_batch_and_late_rows_have_no_track(spark, det, tmp_path):
    src = str(tmp_path / "in")
    for k, (a, b) in enumerate([(0, 10), (10, 25), (25, 99)]):
        spark.createDataFrame(det[(det.block >= a) & (det.block < b)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = run(J.stream_tracks(spark.readStream.schema(SCHEMA).parquet(src)), tmp_path / "out")
        assert got.count() == (det.block < b).sum()
    assert {(r.capture_id, r.block, r.det): r.track for r in got.collect()} == plain(det)
    late = pd.DataFrame([(0, 3, 9, 0.0, 9.0, 0.0)], columns=det.columns)
    spark.createDataFrame(late, SCHEMA).write.mode("append").parquet(src)
    out = run(J.stream_tracks(spark.readStream.schema(SCHEMA).parquet(src)), tmp_path / "out")
    assert out.count() == len(det) + 1 and out.where("track IS NULL").count() == 1


def test_stream_tracks_take_a_block_in_two_parts(spark, tmp_path):
    src = str(tmp_path / "in")
    parts = [[(0, 0, 0, 0.0, 9.0, 1.0), (0, 0, 1, 20.0, 29.0, 1.0), (0, 1, 0, 0.0, 9.0, 1.0)], [(0, 1, 1, 20.0, 29.0, 1.0), (0, 1, 2, 50.0, 59.0, 1.0)]]
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = run(J.stream_tracks(spark.readStream.schema(SCHEMA).parquet(src)), tmp_path / "out")
    assert {(r.block, r.det): r.track for r in got.collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 1, (1, 2): 2}


def test_watch_folder_sees_each_file_once_also_after_restart(spark, tmp_path):
    d = tmp_path / "captures"
    d.mkdir()
    (d / "a.cu8").write_bytes(b"12")
    (d / "skip.txt").write_text("x")
    assert [r.name for r in run(J.watch_folder(spark, str(d)), tmp_path / "o").collect()] == ["a.cu8"]
    (d / "b.iq").write_bytes(b"12345678")
    got = run(J.watch_folder(spark, str(d)), tmp_path / "o").collect()
    assert sorted((r.name, r.size) for r in got) == [("a.cu8", 2), ("b.iq", 8)]


def test_stable_files(spark, tmp_path):
    src = str(tmp_path / "in")
    polls = [[("a", 5), ("b", 1)], [("a", 5), ("b", 2), ("c", 1)], [("a", 5), ("b", 2)], [("c", 1)], [("c", 1), ("a", 5)], [("a", 5)]]
    out = None
    for n, p in enumerate(polls):
        spark.createDataFrame([(x, s, n) for x, s in p], "path string, size long, poll long").coalesce(1).write.mode("append").parquet(src)
        out = run(J.stable_files(spark.readStream.schema("path string, size long, poll long").parquet(src)), tmp_path / "out")
    # a stable at poll 1; b at 2; c vanished and came back at 3, stable at 4; a was forgotten and is stable again at 5
    assert sorted((r.path, r.poll) for r in out.collect()) == [("a", 1), ("a", 5), ("b", 2), ("c", 4)]


def state_rows(stream, folder):
    """Run over what is there now; rows left in state."""
    q = (stream.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q.lastProgress.stateOperators[0].numRowsTotal


def test_state_of_vanished_files_leaves(spark, tmp_path):
    src, sch = str(tmp_path / "in"), "path string, size long, poll long"
    put = lambda n, names: spark.createDataFrame([(x, 1, n) for x in names], sch).coalesce(1).write.mode("append").parquet(src)
    go = lambda: state_rows(J.stable_files(spark.readStream.schema(sch).parquet(src)), tmp_path / "out")
    put(0, [f"f{i}" for i in range(200)])
    many = go()
    for n in (1, 2, 3):
        put(n, ["f0", "f1"])
        few = go()
    assert few < many / 20


def test_state_of_silent_captures_leaves(spark, tmp_path):
    src = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    go = lambda: state_rows(J.stream_tracks(spark.readStream.schema(SCHEMA).parquet(src), keep=10), tmp_path / "out")
    put([(c, 0, k, 20.0 * k, 20.0 * k + 9, 1.0) for c in range(50) for k in range(3)])
    many = go()
    for b in range(1, 31):
        if b % 10 == 0:
            put([(0, x, 0, 0.0, 9.0, 1.0) for x in range(b - 9, b + 1)])
            few = go()
    assert many >= 200 and few < many / 20
    got = spark.read.parquet(str(tmp_path / "out/table")).where("capture_id = 0").collect()
    assert {r.track for r in got if r.block} == {0}


def test_captures_of_few_tracks_share_a_row_of_state(spark, tmp_path):
    src = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    go = lambda: state_rows(J.stream_tracks(spark.readStream.schema(SCHEMA).parquet(src)), tmp_path / "out")
    put([(c, 0, 0, 0.0, 9.0, 1.0) for c in range(500)])
    assert go() < 20


def test_captures_between_few_and_many_tracks_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(c, b, k, 20.0 * s, 20.0 * s + 9, 1.0) for c in range(30) for b in range(12)
            for k, s in enumerate(sorted(rng.choice(6, rng.integers(0, 6), replace=False)))]
    det = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    src = str(tmp_path / "in")
    for b in range(0, 12, 2):
        spark.createDataFrame(det[det.block.between(b, b + 1)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = run(J.stream_tracks(spark.readStream.schema(SCHEMA).parquet(src)), tmp_path / "out")
    assert {(r.capture_id, r.block, r.det): r.track for r in got.collect()} == plain(det)


def test_await_sidecar(spark, tmp_path):
    sch = "stem string, name string, ts timestamp"
    mk = lambda rows: spark.createDataFrame([(s, n, pd.Timestamp(t).to_pydatetime()) for s, n, t in rows], sch)
    mk([("x", "x.sigmf-data", "2024-01-01 00:00:00"), ("y", "y.sigmf-data", "2024-01-01 00:00:01")]).write.parquet(str(tmp_path / "d"))
    mk([("x", "x.sigmf-meta", "2024-01-01 00:00:05")]).write.parquet(str(tmp_path / "m"))
    rd = lambda p: spark.readStream.schema(sch).parquet(str(tmp_path / p))
    got = run(J.await_sidecar(rd("d"), rd("m"), "10 seconds", "1 minute"), tmp_path / "o").collect()
    assert [(r.stem, r.meta_name) for r in got] == [("x", "x.sigmf-meta")]
    # later files move the watermark on: the unmatched one is reported
    go = lambda: run(J.await_sidecar(rd("d"), rd("m"), "10 seconds", "1 minute", outer=True), tmp_path / "o2")
    go()
    for p in "dm":
        mk([("z", "z", "2024-01-01 01:00:00")]).write.mode("append").parquet(str(tmp_path / p))
    got = go().collect()
    assert ("y", None) in [(r.stem, r.meta_name) for r in got]


def test_sinks_keep_going_past_bad_rows(spark, tmp_path):
    sch = "file string, id long, lo double"
    spark.createDataFrame([("f", 1, 2.0), ("f", 2, None), ("g", 3, 1.0)], sch).write.parquet(str(tmp_path / "in"))
    q = J.stream_sinks(spark.readStream.schema(sch).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lambda: F.col("lo").isNull()).start()
    q.awaitTermination()
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/detections")).collect()]
    assert sorted(x["id"] for x in lines) == [1, 3]
    assert spark.read.schema(sch).json(str(tmp_path / "out/errors")).first().id == 2


def test_progress_rows(spark, tmp_path):
    import time
    p = J.Progress()
    spark.streams.addListener(p)
    try:
        spark.range(10).write.parquet(str(tmp_path / "in"))
        run(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), tmp_path / "o")
        for _ in range(50):
            if any(r["message"] == "done" for r in p.rows):
                break
            time.sleep(0.1)
        assert p.table(spark).agg(F.sum("rows")).first()[0] == 10
    finally:
        spark.streams.removeListener(p)
