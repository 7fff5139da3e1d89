import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import features, regions, weekly
from fieldloom.operators.splits import day_rows, spread, trim, week_rows
from fieldloom.plans import preprocess as plan
from fieldloom.sources import panel, tables


def days(spark, n, prec=1.0):
    rows = [(1, i, f"2021-01-{i + 1:02d}", prec, float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "region_id long, pos long, date string, prec double, tmp double")


def weeks(spark, values, col="prec", region=1):
    return spark.createDataFrame([(region, i, None if v is None else float(v)) for i, v in enumerate(values)], f"region_id long, week_idx long, {col} double")


def column(df, c):
    return [r[c] for r in df.orderBy("region_id", "week_idx").collect()]


def test_eight_days_make_two_weeks(spark):
    out = weekly.roll_up(days(spark, 8))
    assert column(out, "prec") == [7, 1]
    assert column(out, "tmp_week_std")[1] == 0
    assert column(out, "week_end_date") == ["2021-01-07", "2021-01-08"]


def test_week_without_rain_data(spark):
    out = weekly.roll_up(days(spark, 7, prec=None))
    assert column(out, "prec") == [0] and column(out, "prec_week_max") == [None]


def test_trailing_sum(spark):
    assert column(features.rolling(weeks(spark, [1.0, 2, 3, 4, 5])), "prec_roll_sum_4w") == [1, 3, 6, 10, 14]
    assert column(features.rolling(weeks(spark, [None, 2.0])), "prec_roll_sum_4w") == [None, 2]


def test_dry_spell_needs_data(spark):
    assert column(features.dry_spell(weeks(spark, [None, None, 0.2])), "is_dry_spell") == [0, 0, 1]


def test_momentum(spark):
    assert column(features.momentum(weeks(spark, [1.0, 2, 3], "water_shortage")), "shortage_momentum") == [16, 100, 289]


def test_unseen_region_uses_its_own_mean(spark):
    test = weeks(spark, [10.0, 12.0], "tmp", region=9)
    train = features.fit_anomaly(weeks(spark, [1.0, 3.0], "tmp"))
    out = features.anomaly(test, features.fit_anomaly_for_test(test, train))
    assert column(out, "tmp_anomaly") == [-1, 1]


def test_constant_region_gets_sd_one(spark):
    df = weeks(spark, [4.0, 4.0], "tmp")
    assert column(features.anomaly(df, features.fit_anomaly(df)), "tmp_anomaly") == [0, 0]


def test_region_without_scores(spark):
    df = weeks(spark, [1.0, 2.0], "tmp").withColumn("prec", F.lit(0.0)).withColumn("score", F.lit(None).cast("double"))
    r = regions.region_stats_v51(df).first()
    assert (r["score_mean"], r["score_zero_prob"], r["score_std"]) == (0, 0.5, 0)


def random_daily(spark, long=900, short=60):
    rng = np.random.default_rng(5)
    rows = []
    for region, n in ((1, long), (2, short)):
        for i in range(n):
            rows.append((region, i, f"{2000 + i // 336}-{i // 28 % 12 + 1:02d}-{i % 28 + 1:02d}", *rng.normal(10, 15, 4).tolist()))
    return spark.createDataFrame(rows, "region_id long, pos long, date string, prec double, humidity double, tmp double, wind double")


@pytest.mark.parametrize("variant,width", [("v51", 4), ("v54", 8)])
def test_fused_frames_match_pandas_across_chunks(spark, small_chunks, variant, width):
    daily = random_daily(spark)
    got = plan.weekly_frames(daily, variant).toPandas().sort_values(["region_id", "week_idx"]).reset_index(drop=True)
    pdf = daily.toPandas().sort_values(["region_id", "pos"])
    pdf["week_idx"] = pdf["pos"] // 7
    w = pdf.groupby(["region_id", "week_idx"]).agg(prec=("prec", "sum"), tmp=("tmp", "mean"), sd=("tmp", "std")).reset_index()
    assert len(got) == len(w)
    np.testing.assert_allclose(got["tmp_week_std"], w["sd"].fillna(0))
    pet = 0.55 * w["tmp"].clip(lower=0)
    name = "deficit" if variant == "v51" else "water_shortage"
    w[name] = w["prec"] - pet if variant == "v51" else (pet - w["prec"]).clip(lower=0)
    want = w.groupby("region_id")[name].transform(lambda s: s.rolling(width, min_periods=1).sum())
    np.testing.assert_allclose(got[f"{name}_roll_cum_{width}w"], want, atol=1e-9)
    rolled = w.groupby("region_id")["tmp"].transform(lambda s: s.rolling(4, min_periods=1).mean())
    np.testing.assert_allclose(got["tmp_roll_mean_4w"], rolled)
    if variant == "v51":
        np.testing.assert_allclose(got["tmp_lag2w"], w.groupby("region_id")["tmp"].shift(2))


def test_fused_plan_shuffles_weeks_not_days(spark):
    """Days are aggregated by hash before the first shuffle; all trailing features share the second."""
    text = plan.weekly_frames(random_daily(spark), "v54")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in text and text.count("HashAggregate") == 2


def test_pipeline_shapes(spark, sf_dir):
    from fieldloom.checks import inputs
    train, test = inputs.panels(spark, sf_dir, "v51")
    assert train.count() == 10 * 343 and test.count() == 10 * 13
    assert {"cluster_id"}.isdisjoint(train.columns) and "score" not in test.columns
    assert features.size_violations(test, 13).count() == 0


def test_fixture_totals(spark, sf_dir):
    r = panel.order_line_panel(spark, sf_dir).agg(
        F.count("*"), F.count("prec"), F.round(F.sum("prec"), 3), F.round(F.sum("tmp"), 3), F.count("score"), F.sum("score")).first()
    assert tuple(r) == (24988, 5333, 7712.9, 175184.113, 3430, 4110.5)


def test_clusters_are_ordered_from_wet_to_dry(spark):
    rows = [(i, float(i % 3), 0.1 * i, 1.0, float(i % 4), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "region_id long, score_mean double, score_zero_prob double, score_std double, tmp_mean double, prec_mean double")
    out = regions.cluster_regions(df, k=3, restarts=2)
    means = [r["m"] for r in out.groupBy("cluster_id").agg(F.avg("prec_mean").alias("m")).orderBy("cluster_id").collect()]
    assert len(means) == 3 and means == sorted(means, reverse=True)
    seen = regions.assign_clusters(weeks(spark, [1.0], "tmp", region=77), out)
    assert column(seen, "cluster_id") == [0]


def test_end_dates_come_back_as_they_were_written(spark):
    rows = [(1, f"{y}-01-0{d}", 1.0) for y in ("0001",) for d in range(1, 8)] + [(2, f"1-01-0{d}", 1.0) for d in range(1, 8)]
    rows += [(3, f"12021-02-2{d}", 1.0) for d in range(3, 10)]
    daily = panel.index_panel(spark.createDataFrame(rows, "region_id long, date string, prec double"))
    got = {r.region_id: r.week_end_date for r in weekly.roll_up(daily).collect()}
    assert got == {1: "0001-01-07", 2: "1-01-07", 3: "12021-02-29"}


def test_csv_keeps_dates_as_text_and_declared_types(spark, tmp_path):
    rows = [(7, 0, "2021-01-07", 1.5, 3, 738000)]
    df = spark.createDataFrame(rows, "region_id long, week_idx long, week_end_date string, prec double, cluster_id byte, day_ordinal long")
    tables.write_panel(df, f"{tmp_path}/t", "csv")
    back = tables.read_table(spark, f"{tmp_path}/t", "csv")
    assert back.schema == df.schema and back.collect() == df.collect()
