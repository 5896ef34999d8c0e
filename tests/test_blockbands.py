"""The in-task band kernel against the relational operators on constructed captures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigspark.operators import blockbands as B, regions as R, spectra as S
from tests.test_detect import FS, FRAGMENTS, HOP, NFFT, capture, noise, tone


def busy(seed):
    """Bursts at many distances in frequency and time, some weak beside strong ones."""
    r = np.random.default_rng(seed)
    x = noise(8192, seed)
    for _ in range(14):
        a, n = int(r.integers(0, 7000)), int(r.integers(300, 2500))
        n = min(n, len(x) - a)
        f = r.uniform(-22_000, 22_000)
        x[a:a + n] += tone(n, f) * 10 ** r.uniform(-1.2, 0.3)
        if r.random() < 0.6:  # a lobe close by, at the same time
            x[a:a + n] += tone(n, f + r.uniform(2500, 9000)) * 10 ** r.uniform(-1.2, 0.3)
    return x


def blocks(spark, xs, block=4096, guard=256):
    c = None
    for cid, x in enumerate(xs):
        y = capture(spark, x, cid)
        c = y if c is None else c.union(y)
    return S.blocks_from_chunks(c, block, guard)


def rounded(df):
    skip = {"status"}
    cols = [F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes if c not in skip]
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("margin, fixed, merge", [(8.0, None, True), (4.0, None, True), (8.0, -45.0, True), (6.0, None, False)])
def test_kernel_equals_relational_detection(spark, margin, fixed, merge):
    b = blocks(spark, [busy(s) for s in range(6)])
    want = R.detect(S.scan_blocks(b, FS, NFFT, HOP, margin, fixed), FS, NFFT, HOP, margin, fixed, merge=merge)
    got = B.detect(b, FS, NFFT, HOP, margin, fixed, merge=merge)
    assert len(rounded(want)) > 5 and rounded(got) == rounded(want.withColumns({c: F.col(c).cast("int") for c in ("fa", "fb")}))


def test_real_input(spark):
    b = blocks(spark, [busy(s).real + 0j for s in range(3)])
    want = R.detect(S.scan_blocks(b, FS, NFFT, HOP, 6.0, real=True), FS, NFFT, HOP, 6.0, real=True)
    assert rounded(B.detect(b, FS, NFFT, HOP, 6.0, real=True)) == rounded(want.withColumns({c: F.col(c).cast("int") for c in ("fa", "fb")})) != []


def test_some_neighbours_join_and_some_do_not(spark):
    b = blocks(spark, [busy(s) for s in range(6)])
    rows = B.band_rows(b, FS, NFFT, HOP, 6.0).collect()
    assert any(r.n_parts > 1 for r in rows) and any(r.n_parts == 1 for r in rows)
    assert all(r.part_bins <= r.n_bins == r.fb - r.fa for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, levels, _) in FRAGMENTS.items() if not levels])
def test_rule_on_known_fragments(name):
    """The pair rule of the kernel on masks and levels drawn from the cases of the relational rule (no filled gaps)."""
    bands, _, want = FRAGMENTS[name]
    hit, smooth = np.zeros((10, 64), bool), np.full((10, 64), 1e-9)
    for fa, fb, t, peak in bands:
        rows = np.array(range(t) if isinstance(t, int) else list(t))
        hit[rows[:, None], np.arange(fa, fb)] = True
        smooth[rows[:, None], np.arange(fa, fb)] = 10 ** (peak / 10)
    assert B.joined([b[:2] for b in bands], np.full((10, 64), 1.0), smooth, hit) == want


def test_filled_gaps():
    """Levels as in the relational cases: a gap well above the noise joins, one at the noise or in a deep valley does not."""
    for (left, right, gap), want in (((10.0, 8.0, 2.0), True), ((10.0, 8.0, 1.0), False), ((100.0, 80.0, 2.0), False)):
        power = np.ones((6, 64))
        power[:, 14:22], power[:, 28:34], power[:, 22:28] = left, right, gap
        hit = np.zeros((6, 64), bool)
        hit[:, 14:22] = hit[:, 28:34] = True
        smooth = np.where(np.arange(64) < 25, 100.0, 63.0) * np.ones((6, 1))
        assert B.joined([(14, 22), (28, 34)], power, smooth, hit) == [want]


def test_sweep_equals_relational_sweep(spark):
    b = blocks(spark, [busy(s) for s in range(3)])
    want = R.margin_sweep(S.scan_blocks(b, FS, NFFT, HOP, 6.0), [4.0, 6.0, 10.0])
    cols = ["margin_db", "capture_id", "block_id", "fa", "fb", "active_frames", "hit_cells"]
    assert sorted(map(tuple, B.margin_sweep(b, FS, NFFT, HOP, [4.0, 6.0, 10.0]).select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_short_blocks_come_out_with_a_reason(spark):
    got = B.detect(blocks(spark, [noise(40), busy(1)], 512, 0), FS, NFFT, HOP).collect()
    short = [r for r in got if r.capture_id == 0]
    assert [(r.fa, r.confidence, r.start_sample, r.bounds_method, r.status) for r in short] == [(None, None, None, None, "fewer than 64 samples (40)")]
    assert all(r.status == "ok" and r.fa is not None for r in got if r.capture_id == 1) and len(got) > 1
    assert B.detect(blocks(spark, [busy(1)], 512, 0).limit(0), FS, NFFT, HOP).count() == 0


def test_no_array_is_shuffled_after_the_blocks(spark):
    b = blocks(spark, [busy(1)])
    n = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert n(B.detect(b, FS, NFFT, HOP)) == n(b) == n(B.margin_sweep(b, FS, NFFT, HOP, [4.0]))


def test_detection_runs_after_the_robust_floor(spark):
    """Functions sent to tasks carry their modules: none may hold a Spark function that the session has used."""
    assert spark.range(1, 4).select(S.gamma_ratio(F.col("id")).alias("q")).where("q > 0 AND q < 1").count() == 3
    assert B.detect(blocks(spark, [busy(1)]), FS, NFFT, HOP).where("status = 'ok'").count() > 0
