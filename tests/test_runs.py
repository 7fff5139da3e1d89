"""Days and weeks are unfolded from runs: the same rows as by the general operators, without moving them."""

from pyspark.sql import functions as F

from fieldloom.checks import inputs as src
from fieldloom.constants import MEASURES
from fieldloom.operators import impute
from fieldloom.sources import panel


def _moved(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_weeks_are_made_where_the_runs_lie(spark, sf_dir):
    for variant in ("v51", "v54"):
        assert not _moved(src.weekly_train(spark, sf_dir, variant).select("region_id", "week_idx", "prec", "humidity_week_std")), variant
    assert not _moved(src.train(spark, sf_dir).select("region_id", "date"))


def test_other_sessions_keep_their_settings(spark, sf_dir):
    src.runs(spark, sf_dir)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_numbers_of_runs_are_those_of_days(spark, sf_dir):
    days = panel.train_part(panel.order_line_panel(spark, sf_dir))
    general = panel.index_panel(days).select("region_id", "date", "ordinal", "pos")
    ours = src.train(spark, sf_dir).select("region_id", "date", "ordinal", "pos")
    assert sorted(map(tuple, general.collect())) == sorted(map(tuple, ours.collect()))


def test_filled_runs_are_filled_days(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in MEASURES]
    days = impute.fill_both_ways(src.train(spark, sf_dir)).select("region_id", "pos", *rounded)
    runs = src.filled_train(spark, sf_dir, "v51").select("region_id", "pos", *rounded)
    assert sorted(map(tuple, days.collect())) == sorted(map(tuple, runs.collect()))


def test_lines_of_unknown_suppliers_and_missing_february_29(spark, tmp_path):
    spark.sql("select 9L as s_suppkey union all select 3L").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql(
        "select * from values (9L, 1d, 1000d, 0.1d, 0.0d, timestamp'1996-02-29'), (9L, 2d, 1000d, 0.1d, 0.0d, timestamp'1996-02-28'), "
        "(3L, 3d, 1000d, 0.1d, 0.0d, timestamp'1996-02-29'), (4L, 4d, 1000d, 0.1d, 0.0d, timestamp'1996-02-28') "
        "as t(l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = panel.order_line_panel(spark, str(tmp_path))
    sizes = {r["region_id"]: r["n"] for r in got.groupBy("region_id").agg(F.count("*").alias("n")).collect()}
    assert sizes == {3: panel.DAYS, 9: panel.DAYS - 2}
    known = sorted((r["region_id"], r["date"], r["surf_pre"]) for r in got.filter("surf_pre is not null").collect())
    assert known == [(3, "1999-02-29", 3.0), (9, "1997-02-28", 2.0)]
