"""The spans of a track become one row: one shuffle, the same as a plain loop."""

import numpy as np
import pytest

from sigspark.operators import tracks as T
from sigspark.plans import load, views as V

SCHEMA = "capture_id long, track long, idx long, label string, rate double, ok boolean, cf double, bw3 double, bw99 double, snr double"


def test_spans_meet_once(spark):
    plan = load().QUERIES["combine_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("FileScan") == 1


def test_spans_equal_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    some = lambda v, p=0.2: None if rng.random() < p else v
    rows = [(c, t, i, some(str(rng.choice(["A", "A", "A", "B"][:3 + t % 2]))), some(100.0 + float(rng.integers(0, 8)), 0.1), some(bool(rng.random() < 0.8), 0.05),
             *[some(float(v)) for v in rng.normal(size=4)]) for c in range(3) for t in range(40) for i in range(rng.integers(1, 9))]
    got = {(r.capture_id, r.track): r for r in T.combine_spans(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    mid = lambda v: pytest.approx(float(np.median(v))) if v else None
    for key in {r[:2] for r in rows}:
        all_ = sorted(r for r in rows if r[:2] == key)
        good, r = [x for x in all_ if x[5]], got.pop(key)
        labels = [x[3] for x in good if x[3]]
        label = labels[0] if len(set(labels)) == 1 and 2 * len(labels) >= len(all_) else None
        rates = [x[4] for x in good if x[3] and x[4] is not None]
        steady = label and len(rates) == len(labels) and max(abs(v - np.median(rates)) for v in rates) <= 0.05 * np.median(rates)
        fits = [(abs(k - (len(good) - 1) / 2), x[2]) for k, x in enumerate(good) if label is None or x[3] == label]
        assert (r.n_spans, r.n_failed, r.modulation_label) == (len(all_), len(all_) - len(good), label)
        assert r.symbol_rate_hz == (mid(rates) if steady else None) and r.rep_idx == (min(fits)[1] if fits else None)
        assert [r.center_frequency_hz, r.bandwidth_3db_hz, r.bandwidth_99pct_hz, r.snr_db] == [mid([x[k] for x in good if x[k] is not None]) for k in (6, 7, 8, 9)]
        assert (r.status is None) == (label is not None or not good)
    assert not got


def test_lines_and_flags_out_of_range_have_no_expert_or_label(spark, tmp_path):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(1)
    odd = [(n, f) for n in (0, 8, None, 3) for f in ("A", "X", None)]
    li.drop("l_linenumber", "l_returnflag").crossJoin(spark.createDataFrame(odd, "l_linenumber int, l_returnflag string")).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = V.hypotheses(spark, str(tmp_path)).collect()
    assert len(got) == 12 and sorted((r.expert or "", r.label or "") for r in got)[-3:] == [("lsp", ""), ("lsp", ""), ("lsp", "QPSK")]
    assert sum(r.expert is None and r.label is None for r in got) == 9
