"""Functions sent to tasks carry their modules, so no module of the analysis may hold a function of Spark's."""

import sys

from pyspark.sql import Column

from sigspark.plans import load


def test_no_module_holds_a_spark_function():
    load()
    held = [(m, n) for m, mod in list(sys.modules.items()) if m.startswith(("sigspark.operators", "sigspark.plans", "sigspark.functions", "sigspark.sources", "sigspark.streaming"))
            for n, v in vars(mod).items() if isinstance(v, Column) or hasattr(v, "evalType")]
    assert held == []
