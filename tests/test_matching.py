"""Truths and detections meet in frequency bins: any width gives the same answer, the usual one few copies."""

import pytest

from sigspark.operators import scoring as M
from sigspark.plans import load, views as V

SF = "/root/testdata/sf0.001"


def test_a_band_is_seldom_copied(spark):
    d = V.detected_bands(spark, SF)
    assert M._binned(d, "lo", "hi", M.BIN_HZ).count() < 1.5 * d.count()


def test_bins_change_no_match(spark):
    t, d = V.truth_bands(spark, SF), V.detected_bands(spark, SF)
    for f, cols in ((M.match_best_overlap, [*M.TRUTH, "n_det", "n_overlap", "best_det", "overlap_hz"]), (M.match_time_freq, [*M.TRUTH, "det", "excess"])):
        a, b = (sorted(map(str, f(t, d, *w).select(*cols).collect())) for w in ((50.0,), ()))
        assert a == b != []


@pytest.mark.parametrize("name", ["bounds_stats", "width_ratio", "match_best_overlap", "match_time_freq", "match_center_in_band",
                                  "flag_detections", "spread_summary"])
def test_truths_are_merged_not_broadcast(spark, name):
    plan = load().QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
