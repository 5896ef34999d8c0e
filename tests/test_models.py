"""Scores, labels and experts on constructed signals and small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark.operators import features as FE, hypotheses as K, scoring as M, symbols as L


def samples(spark, x, key=1):
    return spark.createDataFrame(pd.DataFrame({"capture_id": key, "n": np.arange(len(x)), "i": x.real, "q": x.imag}))


@pytest.mark.parametrize("order", [2, 4, 8, 16])
def test_right_alphabet_wins(spark, order):
    r = np.random.default_rng(order)
    pts = np.array([complex(a, b) for a, b in K._points(order)])
    x = np.repeat(pts[r.integers(0, order, 300)], 8) * np.exp(0.3j) + (r.normal(size=2400) + 1j * r.normal(size=2400)) * 0.08
    s = K.symbol_means(samples(spark, x), ["capture_id"], "n", [1000.0], 8000.0)
    a = K.score_alphabets(s, ["capture_id"]).orderBy("score").first()
    assert a.label == K.PSK_LABEL[order] and a.usage > 0.01


def test_two_level_keying_beats_psk(spark):
    r = np.random.default_rng(3)
    x = np.repeat(r.integers(0, 2, 300) * 1.0, 8) * np.exp(0.9j) + (r.normal(size=2400) + 1j * r.normal(size=2400)) * 0.05
    s = K.symbol_means(samples(spark, x), ["capture_id"], "n", [1000.0], 8000.0)
    assert K.score_ask(s, ["capture_id"]).first().score < K.score_alphabets(s, ["capture_id"]).agg(F.min("score")).first()[0]


def test_fsk_bits_recovered(spark):
    r = np.random.default_rng(4)
    bits = r.integers(0, 2, 200)
    f = np.convolve(np.repeat(np.where(bits, 0.4, -0.4), 10), np.ones(5) / 5, "same")
    x = np.exp(1j * np.cumsum(f))
    from sigspark.operators.pulses import instantaneous_frequency
    fi = instantaneous_frequency(samples(spark, x), ["capture_id"], 1.0).withColumn("n", F.col("n") - 1)
    ep = L.symbol_epoch(fi, ["capture_id"], "n", "fi", 10.0)
    b, c = L.demap_fsk(L.integrate_and_dump(fi, ep, ["capture_id"], "n", ["fi"], 10.0), ["capture_id"], "fi")
    assert c.first().decoded
    t = spark.createDataFrame([(1, k, int(v)) for k, v in enumerate(bits)], "capture_id int, k long, bit int")
    assert L.align_sequences(b, t, ["capture_id"]).first().error_rate < 0.02


def test_iq_pair_evidence(spark):
    n = np.arange(4096)
    x = np.exp(2j * np.pi * 0.05 * n) + np.exp(2j * np.pi * 0.11 * n)
    rows = [(1, [float(v) for v in x.real], [float(v) for v in x.imag]), (2, [float(v) for v in x.real], [float(v) for v in np.random.default_rng(0).normal(size=4096)])]
    h = FE.hilbert_blocks(spark.createDataFrame(rows, "capture_id long, i array<double>, q array<double>"))
    z = h.select("capture_id", F.explode(F.arrays_zip("i", "q", "h")).alias("s")).select("capture_id", F.col("s.i").alias("a"), F.col("s.q").alias("b"), F.col("s.h").alias("h"))
    got = {r.capture_id: r.result for r in FE.iq_or_audio(z, ["capture_id"]).collect()}
    assert got == {1: "iq_pair_evidence", 2: "ambiguous"}


def test_gap_proposals_contain_the_rate(spark):
    r = np.random.default_rng(5)
    x = np.repeat(r.choice([1, -1, 1j, -1j], 600), 8)
    b = spark.createDataFrame([(1, [float(v) for v in x.real], [float(v) for v in x.imag])], "k long, i array<double>, q array<double>")
    p = FE.gap_difference_proposals(b, ["k"], 8000.0, (300.0, 3500.0)).first().proposals
    assert any(abs(v - 1000) / 1000 < 0.02 for v in p)


def test_experts_plug_in(spark):
    def flat(p):
        power = float((p.i ** 2 + p.q ** 2).mean())
        return pd.DataFrame([{"label": "FM", "rate": np.nan, "score": np.log(power), "residual": power, "usage": 1.0}])
    K.register_expert("analog", flat)
    s = samples(spark, np.full(100, 2.0 + 0j)).withColumnRenamed("capture_id", "candidate")
    r = K.run_experts(s, ["analog"]).first()
    assert (r.candidate, r.expert, r.label) == (1, "analog", "FM") and np.isclose(r.score, np.log(4))


def test_label_and_rate_tables(spark):
    rows = [("BPSK", "BPSK", True), ("QPSK", "BPSK", False), ("QAM", "QAM16", True), ("FSK", "FSK4", True), ("FSK2", "FSK4", False),
            ("ASK", "ASK2", True), ("BPSK", "noise", False), ("QAM64", "QAM16", False), (None, "BPSK", False)]
    df = spark.createDataFrame(rows, "p string, t string, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", M.label_matches(F.col("p"), F.col("t"))).collect())
    rates = spark.createDataFrame([(1040.0, 1000.0, True, False), (1060.0, 1000.0, False, False), (2010.0, 1000.0, False, True), (2990.0, 1000.0, False, True),
                                   (1000.0, 1000.0, True, False), (1500.0, 1000.0, False, False)], "p double, t double, ok boolean, harm boolean")
    got = rates.withColumn("a", M.rate_matches(F.col("p"), F.col("t"))).withColumn("b", M.harmonic_error(F.col("p"), F.col("t"))).collect()
    assert all((r.a, r.b) == (r.ok, r.harm) for r in got)


def test_empty_denominators_are_null(spark):
    s = spark.createDataFrame([("g", "noise", None, None, None, None, False, False, False, False)],
                              "gen string, truth string, label string, rate double, rate_true double, snr_true double, digital boolean, in_library boolean, out_of_library boolean, claim boolean")
    assert M.label_stats(s, ["gen"]).first().label_correct is None
