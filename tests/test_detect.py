"""Detection of synthetic bursts, block boundaries and fragment joining."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import pulses as P, regions as R, spectra as S, tracks as T, validation as VA

FS, NFFT, HOP = 48_000.0, 64, 16


def capture(spark, x, cid=1, size=512):
    rows = [(cid, k, [float(v) for v in x[k:k + size].real], [float(v) for v in x[k:k + size].imag]) for k in range(0, len(x), size)]
    return spark.createDataFrame(rows, "capture_id long, start long, i array<double>, q array<double>")


def noise(n, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=n) + 1j * r.normal(size=n)) / np.sqrt(2) * 0.05


def tone(n, f):
    return np.exp(2j * np.pi * f * np.arange(n) / FS)


def frames(spark, x, block, guard=256, margin=8.0):
    return S.scan_blocks(S.blocks_from_chunks(capture(spark, x), block, guard), FS, NFFT, HOP, margin)


def test_spectra_do_not_depend_on_block_size(spark):
    x = noise(6000) + np.r_[np.zeros(2000), tone(1500, 9000.0), np.zeros(2500)]
    got = []
    for block in (1024, 2048, 8192):
        f = frames(spark, x, block).where("is_core").orderBy("frame").select("frame", "power").collect()
        got.append(np.array([r.power for r in f]))
        assert [r.frame for r in f] == list(range(len(f)))
    assert np.allclose(got[0], got[1]) and np.allclose(got[0], got[2])
    assert np.allclose(got[0], S.frame_power(x, FS, NFFT, HOP))


def test_burst_is_found_once_with_its_band_and_time(spark):
    x = noise(8192, 3)
    x[3000:5000] += tone(2000, 9000.0)
    d = R.detect(frames(spark, x, 16384), FS, NFFT, HOP).collect()
    assert len(d) == 1
    assert d[0].freq_lower_hz < 9000 < d[0].freq_upper_hz and d[0].freq_upper_hz - d[0].freq_lower_hz < 6000
    assert abs(d[0].start_sample - 3000) < 150 and abs(d[0].end_sample - 5000) < 150
    assert not d[0].needs_review


@pytest.mark.parametrize("seed", range(3))
def test_noise_gives_no_detection(spark, seed):
    assert R.find_bands(frames(spark, noise(8192, seed), 4096)).count() == 0


def test_track_over_many_blocks(spark):
    x = noise(12288, 5)
    x[500:11500] += tone(11000, -7000.0)
    d = R.detect(frames(spark, x, 2048), FS, NFFT, HOP)
    d = d.select("capture_id", F.col("block_id").alias("block"), F.col("fa").cast("int").alias("det"), F.col("freq_lower_hz").alias("lo"),
                 F.col("freq_upper_hz").alias("hi"), F.col("threshold_excess_db").alias("excess"))
    t = T.associate_tracks(d).collect()
    assert len(t) == 6 and {r.track for r in t} == {0}


#: (bands as (first bin, end bin, frames, peak dB), gap levels as (left, right, gap, noise power) by left band, joined?)
FRAGMENTS = {
    "one empty bin between two equal lobes": ([(4, 12, 6, 20.0), (13, 21, 6, 20.0)], {}, [True]),
    "a gap of half the width": ([(4, 12, 6, 20.0), (16, 24, 6, 20.0)], {}, [False]),
    "a weak lobe beside a strong one": ([(4, 12, 6, 20.0), (18, 20, 6, 10.0)], {}, [True]),
    "a weak lobe with a strong band on either side": ([(4, 12, 6, 20.0), (18, 20, 6, 10.0), (24, 32, 6, 20.0)], {}, [False, False]),
    "a gap well above the noise": ([(4, 12, 6, 20.0), (18, 24, 6, 18.0)], {4: (10.0, 8.0, 2.0, 1.0)}, [True]),
    "a gap at the noise": ([(4, 12, 6, 20.0), (18, 24, 6, 18.0)], {4: (10.0, 8.0, 1.0, 1.0)}, [False]),
    "a valley far below both": ([(4, 12, 6, 20.0), (18, 24, 6, 18.0)], {4: (100.0, 80.0, 2.0, 1.0)}, [False]),
    "lobes at different times": ([(4, 12, range(0, 6), 20.0), (13, 21, range(4, 10), 20.0)], {}, [False]),
    "a chain of three": ([(4, 12, 6, 20.0), (13, 21, 6, 20.0), (22, 30, 6, 20.0)], {}, [True, True]),
}


@pytest.mark.parametrize("name", FRAGMENTS)
def test_fragments_of_known_spectra(spark, name):
    bands, levels, want = FRAGMENTS[name]
    frames = lambda x: list(range(x)) if isinstance(x, int) else list(x)
    stats = spark.createDataFrame([(1, 0, fa, fb, frames(t), p) for fa, fb, t, p in bands],
                                  "capture_id long, block_id long, fa int, fb int, frames array<int>, peak_db double")
    end = {fa: fb for fa, fb, _, _ in bands}
    level = spark.createDataFrame([(1, 0, fa, end[fa], *v, 8) for fa, v in levels.items()],
                                  "capture_id long, block_id long, fa int, fb int, left_power double, right_power double, gap_power double, noise_power double, noise_bins long")
    joins = R.joinable(R.band_pairs(stats), level)
    assert [r.joins for r in joins.orderBy("fa").collect()] == want
    assert R.merge_fragments(stats, joins).count() == len(bands) - sum(want)


def test_pulse_train_timing(spark):
    """Width 2,400 and interval 12,000 from sample 4,800: eight pulses in two seconds."""
    x = noise(96_000, 1)
    for k in range(8):
        a = 4800 + 12_000 * k
        x[a:a + 2400] += tone(2400, 8000.0)
    b = S.blocks_from_chunks(capture(spark, x, size=4096), 16_384, 512).withColumns({"lower_hz": F.lit(6000.0), "upper_hz": F.lit(10_000.0)})
    s = S.samples_from_chunks(P.isolate_band(b, FS)).withColumn("total", F.lit(96_000))
    env = P.moving_mean(s, ["capture_id"], "n", F.col("i") * F.col("i") + F.col("q") * F.col("q"), P.envelope_window(FS), "total", 16_384)
    w = P.envelope_window(FS)
    win, summary = P.pulse_windows(env, P.on_level(env, ["capture_id"], "envelope", w, 0.0002), ["capture_id"], "envelope", w, 16_384)
    t = P.pulse_timing(win, ["capture_id"]).first()
    assert summary.first().is_pulsed and t.n_windows == 8
    assert abs(t.pulse_width_samples - 2400) <= 150 and abs(t.pri_samples - 12_000) <= 100


def test_large_capture_becomes_an_error_row(spark):
    t = spark.range(5000).select(F.lit(1).alias("capture_id"), "id").union(spark.range(3).select(F.lit(2), "id"))
    ok, over = VA.check_limits(t, t, ["capture_id"])
    assert {r.capture_id for r in ok.collect()} == {2}
    assert [(r.capture_id, r.n_tracks, "4,096" in r.error) for r in over.collect()] == [(1, 5000, True)]


def test_short_blocks_are_listed(spark):
    b = S.blocks_from_chunks(capture(spark, noise(40)), 512, 0)
    assert S.scan_blocks(b, FS, NFFT, HOP).count() == 0
    assert [(r.capture_id, r.n_samples, r.status) for r in S.short_blocks(b, NFFT).collect()] == [(1, 40, "fewer than 64 samples (40)")]


def test_unusable_captures_are_quarantined(spark):
    ok = spark.range(2000).select(F.lit(1).alias("c"), F.lit(0.5).alias("i"), F.lit(0.1).alias("q"))
    bad = spark.range(2000).select(F.lit(2).alias("c"), F.when(F.col("id") == 1999, float("nan")).otherwise(0.0).alias("i"), F.lit(0.0).alias("q"))
    short = spark.range(10).select(F.lit(3).alias("c"), F.lit(0.5).alias("i"), F.lit(0.1).alias("q"))
    good, why = VA.validate_samples(ok.union(bad).union(short), ["c"])
    assert {r.c for r in good.select("c").distinct().collect()} == {1}
    assert {r.c: r.reason for r in why.collect()} == {2: "contains NaN or infinite samples", 3: "fewer than 1,024 samples"}
