"""Weeks, clip bounds and padding of filled runs, without a row for each day."""

import pytest
from pyspark.sql import functions as F

from fieldloom.checks import catalog, inputs as src
from fieldloom.constants import CLIPPED, MEASURES
from fieldloom.operators import clean, climatology, impute, weekly as wk, windows
from fieldloom.sources import panel


def _rows(df, keys):
    doubles = [f.name for f in df.schema if f.dataType.typeName() == "double"]
    rest = [c for c in df.columns if c not in doubles and c not in keys]
    return sorted(map(tuple, df.select(*keys, *[F.round(c, 5).alias(c) for c in sorted(doubles)], *sorted(rest)).collect()))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_weeks_of_pieces_are_weeks_of_days(spark, sf_dir):
    days = wk.roll_up(clean.keep_first_days(src.clean_train(spark, sf_dir, "v51"), panel.KEEP_DAYS_HERE))
    ours = src.weekly_train(spark, sf_dir, "v51")
    assert set(ours.columns) == set(days.columns)
    keys = ["region_id", "week_idx"]
    for a, b in zip(_rows(days, keys), _rows(ours, keys), strict=True):
        assert a == pytest.approx(b, abs=2e-5) if None not in a else a == b
    for name in ("a6_weekly_rollup", "d1_pet", "w1_roll4", "t2_refine_train_gaps", "t3_windows"):
        assert "_off" not in _plan(catalog.CATALOG[name].run(spark, sf_dir)), name


def test_pieces_with_gaps_short_weeks_and_a_cut(spark):
    """Columns missing for whole runs or the region, a run over several weeks, a first week of one value."""
    runs = spark.createDataFrame(
        [(1, 0, 7, 0, 2.0, None, 30.0), (1, 7, 9, 7, 3.5, 1.0, 30.0), (1, 9, 31, 9, -1.25, None, 30.0), (2, 0, 31, 0, None, None, None)],
        "region_id long, day_idx int, until int, pos long, tmp double, prec double, humidity double")
    off = F.col("off")
    days = runs.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("until") - F.col("day_idx") - 1))).select(
        "region_id", (F.col("pos") + off).alias("pos"), "tmp", "prec", "humidity").filter("pos < 25")
    days = days.withColumn("date", F.format_string("1995-03-%02d", F.col("pos") + 2))
    want = wk.roll_up(days).select("region_id", "week_idx", "tmp", "tmp_week_std", "tmp_week_max", "prec", "prec_week_max", "humidity_week_std")
    got = wk.roll_up_pieces(panel.week_pieces(runs, 25)).select(*want.columns)
    assert _rows(got, ["region_id", "week_idx"]) == _rows(want, ["region_id", "week_idx"])


def test_bounds_and_means_of_runs_are_those_of_days(spark, sf_dir):
    for v in ("v51", "v54"):
        days, runs = src.filled_train(spark, sf_dir, v), src.filled_runs(spark, sf_dir, v)
        want = clean.outlier_stats(days).first().asDict()
        assert clean.outlier_stats_of_parts(runs, src.parts(CLIPPED, v)).first().asDict() == pytest.approx(want, rel=1e-9)
        means = clean.means_of_parts(runs, src.parts(MEASURES, v)).first().asDict()
        assert means == pytest.approx(climatology.global_means(days).first().asDict(), rel=1e-9)


def test_regions_filled_at_once(spark):
    rows = spark.createDataFrame(
        [(1, 0, None, None), (1, 1, 5.0, None), (1, 2, None, 7.0), (1, 3, 1.0, None), (2, 0, None, 4.0), (2, 1, None, None)],
        "region_id long, pos long, tmp double, wind double")
    assert sorted(map(tuple, impute.fill_both_ways(rows, whole=True).collect()), key=str) == sorted(
        map(tuple, impute.fill_both_ways(rows).select(*rows.columns).collect()), key=str)


def test_only_the_slots_of_the_padding_are_averaged(spark, sf_dir):
    for v in ("v51", "v54"):
        usual = climatology.pad_from_climatology(*src.clean(spark, sf_dir, v), src.pad_weeks(v))
        ours = src.padded_test(spark, sf_dir, v)
        cols = ["date", *MEASURES]
        assert _rows(ours.select("region_id", "pos", *cols), ["region_id", "pos"]) == _rows(usual.select("region_id", "pos", *cols), ["region_id", "pos"])
        days, known, _ = src.pad(spark, sf_dir, v)
        assert known.count() <= days.count()


def test_short_regions_are_numbered_in_one_pass(spark):
    weeks = spark.createDataFrame([(1, 3), (1, 5), (1, 9), (2, 0)], "region_id long, week_idx long")
    whole = windows.renumber(weeks, whole=True)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, windows.renumber(weeks).select(*whole.columns).collect()))
    assert "Join" not in _plan(whole)
