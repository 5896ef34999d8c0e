"""Whole-track sums against one array, whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import spectra as S, wholetrack as W
from tests.test_detect import FS, HOP, NFFT, capture, noise, tone

TRACKS = "capture_id long, track long, lo double, hi double, start_sample long, end_sample long"


def signal():
    x = noise(20_000, 2)
    x[3000:17_000] += tone(14_000, 9000.0) * np.linspace(0.3, 1.0, 14_000)
    return x


@pytest.mark.parametrize("block", [1024, 4096, 32_768])
def test_any_block_size_gives_the_sums_of_the_whole(spark, block):
    x = signal()
    rows = [(1, 0, 8000.0, 10_000.0, 3000, 17_000), (1, 1, -24_000.0, 0.0, 0, 20_000), (1, 2, 0.0, 1.0, 5000, 5020), (1, 3, 0.0, 1.0, 7, 7)]
    t = spark.createDataFrame(rows, TRACKS)
    b = S.blocks_from_chunks(capture(spark, x), block, 256)
    got = {r.track: r for r in W.measure_tracks(W.track_partials(b, t, FS, NFFT, HOP, block), t, FS, NFFT).collect()}
    assert set(got) == {0, 1, 2}  # a track without a sample has nothing to measure
    power = S.frame_power(x, FS, NFFT, HOP)
    centre = np.arange(len(power)) * HOP + NFFT / 2
    f = (np.arange(NFFT) - NFFT // 2) * FS / NFFT
    for cid, k, lo, hi, a, z in rows[:3]:
        r, e = got[k], np.abs(x[a:z]) ** 2
        on = power[(centre >= a) & (centre < z)]
        step = (x[a + 1:z] * np.conj(x[a:z - 1])).sum()
        assert (r.n_frames, r.n_samples) == (len(on), z - a) and r.n_blocks == (z - 1) // block - a // block + 1
        assert np.isclose(r.mean_power, e.mean()) and np.isclose(r.peak, e.max()) and np.isclose(r.mean_hz, np.angle(step) * FS / (2 * np.pi))
        if len(on):
            p, own = on.mean(axis=0), (f >= lo) & (f < hi)
            assert np.isclose(r.inband_share, p[own].sum() / p.sum()) and np.isclose(r.centroid_hz, (p[own] * f[own]).sum() / p[own].sum())
    assert abs(got[0].mean_hz - 9000) < 50 and got[0].inband_share > 0.8


def test_a_track_in_a_gap_between_frames_says_so(spark):
    t = spark.createDataFrame([(1, 5, 0.0, 1000.0, 2, 20)], TRACKS)
    b = S.blocks_from_chunks(capture(spark, noise(600)), 1024, 0)
    r = W.measure_tracks(W.track_partials(b, t, FS, NFFT, HOP, 1024), t, FS, NFFT).first()
    assert (r.n_frames, r.n_samples, r.centroid_hz, r.status) == (0, 18, None, "no whole frame")


def test_one_hot_track_is_summed_by_many_tasks(spark):
    """A track over 80 blocks comes out as 80 rows of sums, none with more than a block's samples."""
    x = signal()
    t = spark.createDataFrame([(1, 0, 8000.0, 10_000.0, 0, 20_000)], TRACKS)
    p = W.track_partials(S.blocks_from_chunks(capture(spark, x), 256, 64), t, FS, NFFT, HOP, 256)
    rows = p.select("n_samples").collect()
    assert len(rows) == 79 and max(r.n_samples for r in rows) == 256 and sum(r.n_samples for r in rows) == 20_000
    assert p.where(F.col("n_frames") > 16).count() == 0
