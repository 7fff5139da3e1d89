"""The driver holds no copies of region rows: only a table whose own size allows it is broadcast."""

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import splits, windows
from fieldloom.session import stage


def rows_broadcast(plan) -> int:
    """Rows of all broadcasts in an executed plan."""
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    while plan.getClass().getSimpleName().endswith("QueryStageExec"):
        plan = plan.plan()
    own = plan.metrics().apply("numOutputRows").value() if "BroadcastExchange" in plan.getClass().getSimpleName() else 0
    children = plan.children()
    return own + sum(rows_broadcast(children.apply(i)) for i in range(children.size()))


@pytest.mark.parametrize("threshold, broadcast", [("10m", 3000), ("64k", 0)])
def test_copies_of_region_rows_are_not_broadcast(spark, threshold, broadcast):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    weekly = stage(spark.range(12_000).select((F.col("id") % 4000).alias("region_id"), (F.col("id") / 4000).cast("long").alias("pos")), "test-weeks")
    dim = stage(spark.range(3000).select(F.col("id").alias("region_id"), F.rand(1).alias("m"), F.rand(2).alias("z"), F.rand(3).alias("s"), F.rand(4).alias("t")), "test-dim")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = splits.attach(weekly, dim, "pos")
        got = out.collect()
        assert rows_broadcast(out._jdf.queryExecution().executedPlan()) == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert len(got) == 12_000 and sum(r["m"] is None for r in got) == 3000 and out.columns == ["region_id", "pos", "m", "z", "s", "t"]


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_fold_scores_reach_to_the_last_target(spark, threshold):
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    weekly = spark.createDataFrame([(r, p, 1.0 if p != 2 else None) for r in (1, 2) for p in range(40)], "region_id long, pos long, score double")
    members = spark.createDataFrame([(1, 0, "train", 3), (1, 0, "train", 5), (1, 1, "train", 1), (2, 0, "val", 9)], "region_id long, fold int, split string, start long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = sorted(tuple(r) for r in windows.fold_training_scores(weekly, members).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    until = {0: 5 + 13 + 5, 1: 1 + 13 + 5}
    assert got == sorted((f, 1, p, 1.0) for f in until for p in range(until[f]) if p != 2)
