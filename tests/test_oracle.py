"""Registered queries against their SQL twins on the smallest tables (SF_DIR and ORACLE=all widen it)."""

import os

import pytest

from sigspark.plans import load
from tests.compare import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
FEW = ["normalize_codes", "capture_catalog", "summary_rows", "validate_samples", "blocks_with_guard", "spectrogram", "detections",
       "margin_sweep", "isolate_band", "envelope_power", "pulse_windows", "merge_intervals", "run_length_encode", "candidate_links",
       "combine_spans", "half_power_width", "occupied_99", "raised_tone", "level_clusters", "consensus_rate", "score_alphabets",
       "mdl_winner", "redecide", "burst_vote", "integrate_and_dump", "demap_psk", "align_sequences", "match_best_overlap", "criteria",
       "sanity_rules", "auc_pairs", "isotonic_fit", "isotonic_apply", "precision_threshold", "stratified_split", "triage_report",
       "stream_packets"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def names():
    if os.environ.get("ORACLE") != "all":
        return FEW
    import re
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    text = "".join(open(os.path.join(root, "sigspark/plans", f)).read() for f in sorted(os.listdir(os.path.join(root, "sigspark/plans"))) if f.startswith("q_"))
    return re.findall(r'@query\("([a-z_0-9]+)"', text)


@pytest.mark.parametrize("name", names())
def test_same_rows(spark, con, name):
    r = load()
    if name not in r.ORACLES:
        assert r.QUERIES[name](spark, SF).count() >= 0
        return
    assert compare(r.QUERIES[name](spark, SF), con, r.ORACLES[name]) is None


def test_registration_needs_no_session():
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__; from sigspark.plans import load; r = load(); print(sorted(set(r.QUERIES) - set(r.ORACLES)) == ['gap_difference_proposals', 'score_ask'])"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "True", out.stderr


def test_result_does_not_depend_on_shuffle_partitions(spark):
    q = load().QUERIES["detections"]
    a = sorted(map(tuple, q(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        b = sorted(map(tuple, q(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b
