"""Variants of a decision are columns of one pass over the hypotheses."""

from pyspark.sql import functions as F

from sigspark.operators import hypotheses as K
from sigspark.plans import views as V
from sigspark.plans.q_decisions import VARIANTS

SF = "/root/testdata/sf0.001"


def test_variants_multiply_no_hypothesis(spark):
    x = K.redecide(V.hypotheses(spark, SF), V.candidates(spark, SF), ["candidate"], VARIANTS)
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Aggregate")


def test_variants_equal_their_own_decisions(spark):
    h, c = V.hypotheses(spark, SF), V.candidates(spark, SF)
    cols = ["candidate", "best_label", "best_rate", "m_fam", "m_rate", "m_label", "m_null", "m_fm_digital", "unexplained", "tier"]
    got = K.redecide(h, c, ["candidate"], VARIANTS)
    for name, th, active in VARIANTS:
        want = K.gate(K.mdl_winner(h.where(F.col("expert").isin(*active, "null")), c, ["candidate"]), th).select(*cols)
        mine = got.where(F.col("variant") == name).select(*cols)
        assert sorted(map(str, mine.collect())) == sorted(map(str, want.collect())) and want.count() > 0
