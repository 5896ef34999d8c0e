"""Widths and steps of windows are ranked in one table; steps cross the edges of position blocks."""

import numpy as np

from sigspark.operators import pulses as P


def windows(spark):
    rng = np.random.default_rng(7)
    rows = [(c, int(s), int(s) + int(rng.integers(1, 90))) for c in range(4) for s in sorted(rng.choice(20_000, 50, replace=False))]
    return rows + [(9, 5, 12)]


def test_medians_do_not_depend_on_the_blocks(spark):
    rows = windows(spark)
    df = spark.createDataFrame(rows, "capture_id long, start_sample long, end_sample long")
    for block, whole in ((64, 20), (3000, 20), (1 << 20, 0), (64, 1000)):
        got = {r.capture_id: tuple(r)[1:] for r in P.pulse_timing(df, ["capture_id"], block, whole).collect()}
        for c in range(4):
            s, e = np.array([r[1:] for r in rows if r[0] == c]).T
            assert got[c] == (50, round(float(np.median(e - s))), round(float(np.median(np.diff(s)))))
        assert got[9] == (1, 7, None)


def test_small_captures_are_not_joined_with_their_own_ranks(spark):
    df = spark.createDataFrame(windows(spark), "capture_id long, start_sample long, end_sample long")
    assert "Join" not in P.pulse_timing(df, ["capture_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert P._timing_in_blocks(df, ["capture_id"], 64)._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 3
