"""Six significant digits as text, rounded from the exact value as the SQL does."""

import numpy as np
from pyspark.sql import functions as F

from sigspark.sources import sinks as SK


def test_general_is_six_significant_digits(spark):
    r = np.random.default_rng(4)
    xs = [float(x) for x in np.concatenate([r.normal(0, 1, 500) * 10.0 ** r.integers(-8, 9, 500), 10.0 ** np.arange(-6.0, 8),
                                            [999999.4, 999999.6, 99999.96, 0.00009999996, 123456.0, 100000.0, 0.5, -2.25, 0.0, 1e-4, 1.000005, 2.000015]])]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "v double").select(SK.general(F.col("v"))).collect()]
    assert got == [f"{x:.6g}" for x in xs]
    assert spark.createDataFrame([(None,)], "v double").select(SK.general(F.col("v"))).first()[0] == ""
