"""Captures of a few detections are walked whole, larger ones in pieces: the numbers are the same."""

import numpy as np

from sigspark.operators import tracks as T


def detections(spark):
    r = np.random.default_rng(3)
    rows = [(int(c), int(b), int(k), float(lo), float(lo) + 30.0, float(r.random()))
            for c, blocks in ((1, 40), (2, 6), (3, 1)) for b in range(blocks) for k, lo in enumerate(r.integers(0, 400, 4)) if b % 7]
    return spark.createDataFrame([*rows, (None, 1, 0, 1.0, 2.0, 0.1), (2, 1, 9, None, 2.0, 0.1)],
                                 "capture_id long, block long, det int, lo double, hi double, excess double")


def test_sizes_change_no_number(spark):
    d = detections(spark)
    runs = [sorted(map(tuple, T.associate_tracks(d, 128.0, whole).collect())) for whole in (0, 30, 1 << 16)]
    assert runs[0] == runs[1] == runs[2] and len(runs[0]) == d.where("capture_id IS NOT NULL AND lo IS NOT NULL").count()


def test_small_captures_meet_no_join(spark):
    assert "Join" not in T.associate_tracks(detections(spark))._jdf.queryExecution().optimizedPlan().toString()
