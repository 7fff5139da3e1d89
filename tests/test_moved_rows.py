"""How many rows are moved and stored on the way to the same results."""

import pandas as pd
from pyspark.sql import functions as F

from fieldloom.checks.catalog import CATALOG
from fieldloom.operators import explore, ranks
from fieldloom.session import region_session
from fieldloom.sources import panel


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def moved(node):
    """Rows that the shuffles of an executed plan wrote."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return moved(node.executedPlan())
    if "QueryStage" in node.nodeName():
        return moved(node.plan())
    own = node.metrics().get("shuffleRecordsWritten")
    below = node.children()
    return (own.get().value() if own.isDefined() else 0) + sum(moved(below.apply(i)) for i in range(below.size()))


def test_order_lines_are_moved_once(spark, sf_dir):
    """F8, F9, F10."""
    once = panel.observed_days(region_session(spark), sf_dir, 3)
    assert exchanges(once) == 1


def test_lines_of_large_regions_are_added_up_first(spark, sf_dir):
    once = panel.observed_days(region_session(spark), sf_dir, 3)
    first = panel.observed_days(region_session(spark), sf_dir, 3, most_lines=1)
    assert exchanges(first) == 2
    even = lambda df: sorted(tuple(r) for r in df.select(*[
        F.coalesce(F.round(c, 6), F.lit(-1e9)) if t == "double" else c for c, t in df.dtypes]).collect())
    assert even(once) == even(first)


def test_rows_of_a_frequent_value_are_not_moved(spark):
    """F4."""
    same = spark.range(1000).select(F.lit("g").alias("grp"), "id", F.lit(2.0).alias("value"))
    got = ranks.average_ranks(same, ["id"])
    assert {r["rank"] for r in got.collect()} == {500.5}
    assert moved(got._jdf.queryExecution().executedPlan()) == 0


def test_rank_columns_are_those_of_pandas(spark):
    df = pd.DataFrame({"id": range(500), "week": 3, "a": [i * 7 % 90 for i in range(500)], "b": [0.0] * 400 + [i / 3 for i in range(100)]})
    got = explore.rank_columns(spark.createDataFrame(df), ["a", "b"], ["id", "week"]).toPandas().sort_values("id")
    assert got["a"].tolist() == df["a"].rank().tolist() and got["b"].tolist() == df["b"].rank().tolist()


def test_only_buckets_of_wanted_ranks_are_cut_again(spark, monkeypatch):
    """F35."""
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 20)
    monkeypatch.setattr(ranks, "CUTS", 8)
    values = [i * 37 % 1009 / 8 for i in range(1009)]
    rows = spark.createDataFrame([(v,) for v in values], "value double").withColumn("grp", F.lit("g"))
    placed = ranks.place(rows, probs=[0.99])
    assert 0 < placed.rows.filter(F.size("bucket") > 1).count() < 300 and placed.rows.count() == 1009
    got = {r["prob"]: r["quantile"] for r in ranks.quantiles(rows, [0.0, 0.37, 0.99]).collect()}
    assert all(abs(got[p] - pd.Series(values).quantile(p)) < 1e-9 for p in (0.0, 0.37, 0.99))


def test_cohort_metrics_read_runs(spark, sf_dir):
    """days without lines have no measures, so they are not made only to be skipped."""
    plans = []
    keep = explore.cohort_metrics
    try:
        explore.cohort_metrics = lambda train, test: plans.append(train) or keep(train, test)
        CATALOG["x2_cohort_metrics"].run(spark, sf_dir)
    finally:
        explore.cohort_metrics = keep
    assert plans[0].count() < 0.5 * 10 * panel.TRAIN_DAYS
