"""The whole analysis on captures that straddle, fade, end in a short tail, or cannot be used."""

import numpy as np
from pyspark.sql import functions as F

from sigspark.operators import spectra as S, validation as VA
from sigspark.plans.analyze import analyze, block_health
from tests.test_detect import FS, HOP, NFFT, capture, noise, tone


def run(spark, xs, block=2048, **kw):
    c = None
    for cid, x in xs.items():
        y = capture(spark, x, cid)
        c = y if c is None else c.union(y)
    return analyze(S.blocks_from_chunks(c, block, 256), FS, NFFT, HOP, block, group_hz=4000.0, **kw)


def test_signals_over_blocks_become_tracks_with_all_their_samples(spark):
    straddle = noise(12_288, 1)
    straddle[1500:9000] += tone(7500, 9000.0)  # over four block edges
    fading = noise(12_288, 2)
    fading[:12_000] += tone(12_000, -7000.0) * np.linspace(1.0, 0.25, 12_000)
    tail = noise(8192 + 100, 3)  # the last block holds 100 samples
    tail[6000:] += tone(len(tail) - 6000, 3000.0)
    two = noise(8192, 4)
    two[400:1900] += tone(1500, 9000.0)  # ends inside the guard of the next block
    two[4500:8000] += tone(3500, 9000.0)  # a pause of a whole block in between
    got = run(spark, {1: straddle, 2: fading, 3: tail, 4: two})
    rows = {}
    for r in got.tracks.orderBy("capture_id", "id").collect():
        rows.setdefault(r.capture_id, []).append(r)
    assert got.errors.count() == 0 and {k: len(v) for k, v in rows.items()} == {1: 1, 2: 1, 3: 1, 4: 2}, rows
    a = rows[1][0]
    assert abs(a.start_sample - 1500) < 150 and abs(a.end_sample - 9000) < 150 and a.freq_lower_hz < 9000 < a.freq_upper_hz
    assert a.n_samples == a.end_sample - a.start_sample and abs(a.mean_hz - 9000) < 60 and (a.block_first, a.block_last) == (0, 4)
    assert abs(rows[2][0].end_sample - 12_000) < 300 and rows[2][0].needs_review is not None
    assert 0 <= len(tail) - rows[3][0].end_sample < HOP and rows[3][0].status == "measured"
    assert [r.id for r in rows[4]] == [0, 1] and rows[4][0].end_sample < rows[4][1].start_sample
    d = got.detections.where("capture_id = 1").orderBy("block_id").collect()
    assert all(r.start_sample >= r.block_id * 2048 and r.end_sample <= (r.block_id + 1) * 2048 for r in d) and len(d) == 5


def test_unusable_captures_are_errors_and_the_others_go_on(spark, monkeypatch):
    good = noise(8192, 1)
    good[1000:5000] += tone(4000, 9000.0)
    nan = good.copy()
    nan[7000] = np.nan
    got = run(spark, {1: good, 2: nan, 3: noise(500), 4: good * 1e13})
    assert {r.capture_id: r.error for r in got.errors.collect()} == {2: "contains NaN or infinite samples", 3: "fewer than 1,024 samples", 4: "sample magnitude is too large"}
    assert {r.capture_id for r in got.tracks.collect()} == {1} == {r.capture_id for r in got.detections.collect()}
    many = noise(8192, 2)
    for k in range(5):
        many[1000:5000] += tone(4000, -20_000.0 + 9000 * k)
    monkeypatch.setattr(VA.check_limits, "__defaults__", (3, 200_000))
    got = run(spark, {1: good, 5: many})
    assert {r.capture_id for r in got.tracks.collect()} == {1} and "3 candidates" in got.errors.first().error


def test_health_of_blocks_equals_health_of_samples(spark):
    x = noise(3000)
    x[100] = np.inf
    c = capture(spark, x, 1).union(capture(spark, noise(2000), 2)).union(capture(spark, noise(900), 3))
    got = {r.capture_id: (r.n_samples, r.not_finite, round(r.peak, 9), r.reason) for r in block_health(S.blocks_from_chunks(c, 1024, 128)).collect()}
    want = {r.capture_id: (r.n_samples, r.not_finite, round(r.peak, 9), r.reason) for r in VA.capture_health(S.samples_from_chunks(c), ["capture_id"]).collect()}
    assert got == want


def test_no_capture_gives_an_empty_result(spark):
    b = S.blocks_from_chunks(capture(spark, noise(2000)), 1024, 128).where(F.lit(False))
    got = analyze(b, FS, NFFT, HOP, 1024)
    assert got.tracks.count() == got.errors.count() == got.detections.count() == 0


def test_analysis_runs_after_the_robust_floor(spark):
    assert spark.range(1, 4).select(S.gamma_ratio(F.col("id")).alias("q")).where("q > 0 AND q < 1").count() == 3
    x = noise(8192, 5)
    x[1500:6000] += tone(4500, 9000.0)
    assert run(spark, {1: x}).tracks.count() == 1
