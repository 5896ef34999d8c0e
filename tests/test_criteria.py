"""The criteria read their rows once, however many statistics they hold."""

import pytest
from pyspark.sql import functions as F

from sigspark.operators import scoring as M
from sigspark.plans import load, views as V

SF = "/root/testdata/sf0.001"


def test_criteria_statistics_are_one_pass(spark):
    plan = M.all_stats(V.score_rows(spark, SF), "gen")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("parquet") == 2


def test_parts_are_not_broadcast(spark):
    plan = V.score_rows(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rows_without_a_time_have_no_speed(spark):
    rows = V.score_rows(spark, SF).withColumn("time_s", F.when(F.col("gen") == "A", F.col("time_s")))
    got = {(r.gen, r.stat): r for r in M.all_stats(rows, "gen").collect()}
    assert [g for g, s in sorted(got) if s == "within"] == ["A"]
    want = {(r.gen, r.n, r.within) for r in M.speed_stats(rows, ["gen"]).collect()}
    assert {(g, r.n, r.value) for (g, s), r in got.items() if s == "within"} == want


@pytest.mark.parametrize("name", ["criteria_pivot", "gen_marks"])
def test_tables_of_criteria_read_their_rows_once_and_broadcast_none(spark, name):
    plan = load().QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("BroadcastExchange") <= 1
    broadcast = plan[plan.index("BroadcastExchange"):].splitlines()[1] if "BroadcastExchange" in plan else "LocalTableScan"
    assert "LocalTableScan" in broadcast or "ExistingRDD" in broadcast
