"""Fills with a limit and with means are worked out on runs; days are only unfolded, neither sorted nor joined."""

import math

import pytest
from pyspark.sql import functions as F

from fieldloom.checks import catalog, inputs as src
from fieldloom.constants import MEASURES
from fieldloom.operators import clean, impute


def _rows(df):
    return sorted(map(tuple, df.select("region_id", "pos", *[F.round(c, 6).alias(c) for c in MEASURES]).collect()))


def test_climate_fill_of_runs_is_that_of_days(spark, sf_dir):
    assert _rows(src.filled_train(spark, sf_dir, "v54")) == _rows(impute.fill_climate(src.train(spark, sf_dir)))


def test_region_fill_of_runs_is_that_of_days(spark, sf_dir):
    days = impute.fill_limited(src.train(spark, sf_dir), src.CONTINUOUS)
    assert _rows(src.region_filled_train(spark, sf_dir)) == _rows(impute.fill_region_mean(days, src.CONTINUOUS))


def test_columns_have_gaps_of_their_own(spark):
    runs = spark.createDataFrame(
        [(1, 0, 2, 5.0, None), (1, 2, 3, None, 7.0), (1, 3, 10, 1.0, None), (2, 0, 10, None, None)],
        "region_id long, day_idx int, until int, tmp double, wind double").withColumn("pos", F.col("day_idx").cast("long"))
    off = F.col("off")
    days = runs.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("until") - F.col("day_idx") - 1))).select(
        "region_id", (F.col("pos") + off).alias("pos"), *[F.when(off == 0, F.col(c)).alias(c) for c in ("tmp", "wind")])
    want = impute.fill_limited(days, ["tmp", "wind"])
    held = impute.last_known(runs, ["tmp", "wind"])
    got = held.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("until") - F.col("day_idx") - 1))).select(
        "region_id", (F.col("pos") + off).alias("pos"), *[impute.held_value(c, off).alias(c) for c in ("tmp", "wind")])
    order = lambda df: sorted(map(tuple, df.select("region_id", "pos", "tmp", "wind").collect()))
    assert order(got) == order(want)
    means = want.groupBy("region_id").agg(F.count("*").alias("_n"), F.avg("tmp"), F.avg("wind"))
    assert sorted(map(tuple, impute.held_means(held, ["tmp", "wind"]).collect())) == sorted(map(tuple, means.collect()))


def test_days_are_not_sorted(spark, sf_dir):
    for name in ("i1_ffill_bfill", "i2_ffill_limit3", "i3_region_mean"):
        df = catalog.CATALOG[name].run(spark, sf_dir)
        above = df._jdf.queryExecution().sparkPlan().toString().split("Generate ")[0]
        assert "Window" not in above and "Join" not in above, name


def test_rounding_needs_no_text(spark):
    values = [0.12345, -0.12345, 1e-9, 123456.78905, 2.5e11, 1e300, -3.0, math.inf, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(
        catalog.rounded(F.col("v") + 2.3e-9, 4).alias("ours"), F.round(F.col("v") + 2.3e-9, 4).alias("usual"))
    got = df.collect()
    assert [r["ours"] is None for r in got] == [v is None for v in values]
    assert all(r["ours"] == pytest.approx(r["usual"], rel=1e-15, abs=0) for r in got if r["usual"] is not None)
    plan = catalog.CATALOG["f1_zclip"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan


def test_clipped_runs_are_clipped_days(spark, sf_dir):
    for variant in ("v51", "v54"):
        assert _rows(src.clean_train(spark, sf_dir, variant)) == _rows(clean.clip_outliers(src.filled_train(spark, sf_dir, variant))), variant


def test_bounds_are_worked_out_on_runs(spark, sf_dir):
    plan = src.clean_train(spark, sf_dir, "v54")._jdf.queryExecution().optimizedPlan().toString()
    assert "tmp_sd" not in plan.split("Generate ")[0] and "tmp_sd" in plan
