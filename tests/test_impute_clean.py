import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.constants import MEASURES
from fieldloom.operators import clean, impute, splits

GAPS = [None, 1.0, None, None, None, None, 2.0, None]


def series(spark, values, region=1):
    return spark.createDataFrame([(region, i, v) for i, v in enumerate(values)], "region_id long, pos long, tmp double")


def values(df, col="tmp", order="pos"):
    return [r[col] for r in df.orderBy("region_id", order).collect()]


def test_both_ways(spark):
    assert values(impute.fill_both_ways(series(spark, GAPS))) == [1, 1, 1, 1, 1, 1, 2, 2]


def test_limited(spark):
    assert values(impute.fill_limited(series(spark, GAPS), ["tmp"])) == [None, 1, 1, 1, 1, None, 2, 2]


def test_region_mean_of_filled_values(spark):
    short = impute.fill_limited(series(spark, GAPS), ["tmp"])
    assert values(impute.fill_region_mean(short, ["tmp"])) == pytest.approx([8 / 6, 1, 1, 1, 1, 8 / 6, 2, 2])


def test_climate_fill_reaches_empty_regions(spark):
    df = series(spark, GAPS).unionByName(series(spark, [None, None], region=2))
    step = impute.fill_region_mean(impute.fill_limited(df, ["tmp"]), ["tmp"])
    want = values(impute.fill_global_mean(step, ["tmp"]))
    assert values(impute.fill_climate(df)) == pytest.approx(want)
    assert want[-1] == pytest.approx((8 + 2 * 8 / 6) / 8)


def test_fill_or_zero(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 3.0), (1, 2, None)], "region_id long, week_idx long, x double")
    assert values(impute.fill_or_zero(df, ["x"]), "x", "week_idx") == [0, 3, 3]


def test_clip_leaves_constant_columns(spark):
    assert values(clean.clip_outliers(series(spark, [5.0, 5.0, None]))) == [5, 5, None]


def test_clip_bounds(spark):
    data = [0.0] * 50 + [100.0]
    s = pd.Series(data)
    assert max(values(clean.clip_outliers(series(spark, data)))) == pytest.approx(s.mean() + 3.5 * s.std())


def test_lower_clip_keeps_missing(spark):
    assert values(clean.not_below_zero(series(spark, [-1.0, None, 2.0]), ["tmp"])) == [0, None, 2]


def long_gaps(n=400):
    """Several regions, one far longer than the others, with gaps that span chunks."""
    rows = []
    for region, length in ((1, n), (2, 30), (3, 1)):
        for i in range(length):
            v = float(i * region) if (i * 37 + region) % 11 == 0 and not 80 < i < 250 else None
            rows.append((region, i, v))
    return pd.DataFrame(rows, columns=["region_id", "pos", "tmp"])


def test_fills_across_chunks_match_pandas(spark, small_chunks):
    pdf = long_gaps()
    df = spark.createDataFrame(pdf).withColumn("tmp", F.when(~F.isnan("tmp"), F.col("tmp")))
    both = pdf.groupby("region_id")["tmp"].transform(lambda s: s.ffill().bfill())
    short = pdf.groupby("region_id")["tmp"].transform(lambda s: s.ffill(limit=3))
    same = lambda got, want: pd.Series(got, dtype=float).equals(want.reset_index(drop=True).astype(float))
    assert same(values(impute.fill_both_ways(df)), both)
    assert same(values(impute.fill_limited(df, ["tmp"])), short)


def test_positions_across_blocks(spark):
    rows = [(r, d) for r in (1, 2) for d in range(0, 300, r)]
    df = spark.createDataFrame(rows, "region_id long, day long").orderBy(F.rand(3))
    out = splits.dense_position(df, ["day"], F.floor(F.col("day") / 7)).toPandas().sort_values(["region_id", "day"])
    assert (out["pos"].to_numpy() == out.groupby("region_id").cumcount().to_numpy()).all()


def test_a_halo_longer_than_a_chunk_is_refused(spark):
    with pytest.raises(ValueError):
        splits.spread(series(spark, [1.0]), "pos", 3, back=4)


def test_attach_keeps_every_row(spark):
    df = spark.createDataFrame([(1, i) for i in range(100)] + [(2, 0)], "region_id long, week_idx long")
    dim = spark.createDataFrame([(1, "a")], "region_id long, name string")
    got = splits.attach(df, dim, "week_idx")
    assert got.count() == 101 and got.filter("name = 'a'").count() == 100


def test_null_counts(spark):
    got = {r["column"]: r["nulls"] for r in impute.null_counts(series(spark, GAPS), MEASURES).collect()}
    assert got == {"tmp": 6}
