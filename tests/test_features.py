"""Averaged spectra of stretches that end inside a frame."""

import numpy as np

from sigspark.operators import features as FE
from sigspark.operators.spectra import hann


def test_frames_that_begin_in_a_short_stretch_count(spark):
    rng = np.random.default_rng(1)
    xs = {n: rng.normal(size=n) + 1j * rng.normal(size=n) for n in (10, 32, 192, 790, 800)}
    rows = [(n, x.real.tolist(), x.imag.tolist()) for n, x in xs.items()]
    b = spark.createDataFrame(rows, "k long, i array<double>, q array<double>")
    got = {r.k: r for r in FE.block_spectra(b, ["k"], 32_000.0, 32, length=800).collect()}
    for n, x in xs.items():
        starts = [s for s in range(0, 800 - 32 + 1, 16) if s < n]
        seg = np.array([np.pad(x, (0, 832 - n))[s:s + 32] * hann(32) for s in starts])
        want = (np.abs(np.fft.fftshift(np.fft.fft(seg, axis=1), axes=1)) ** 2 / (32_000.0 * 12)).mean(axis=0)
        assert got[n].segments == len(starts) and np.allclose(got[n].power, want, rtol=1e-12, atol=0)
    whole = {r.k: r.segments for r in FE.block_spectra(b, ["k"], 32_000.0, 32).collect()}
    assert whole == {32: 1, 192: 11, 790: 48, 800: 49}


def test_tone_of_a_short_stretch(spark):
    x = np.exp(2j * np.pi * 0.01 * np.arange(192) ** 1.3)
    b = spark.createDataFrame([(0, x.real.tolist(), x.imag.tolist())], "k long, i array<double>, q array<double>")
    padded = np.pad(x, (0, 16))
    c = spark.createDataFrame([(0, padded.real.tolist(), padded.imag.tolist())], "k long, i array<double>, q array<double>")
    a, z = (FE.raised_tone(y, ["k"], 32_000.0, 32, length=n).first() for y, n in ((b, 800), (c, None)))
    assert a == z != FE.raised_tone(b, ["k"], 32_000.0, 32).first()


def test_router_of_a_short_last_stretch_equals_its_sql(spark, tmp_path):
    """Recordings of 100 and 6 vectors: the second ends inside a frame of its only stretch."""
    from sigspark.plans import load
    from tests.compare import compare
    import duckdb
    rng = np.random.default_rng(3)
    v = rng.normal(size=(106, 64)).astype("float32")
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("router_features", "symbol_rate_delay_multiply"):
        assert compare(load().QUERIES[name](spark, str(tmp_path)), con, load().ORACLES[name]) is None, name
