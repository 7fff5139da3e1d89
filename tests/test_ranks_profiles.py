import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import distributions as dist, explore, hurdle, rank_matrix, ranks
from fieldloom.sources import tables


def values(spark, data, grp="g"):
    return spark.createDataFrame([(grp, i, float(v)) for i, v in enumerate(data)], "grp string, id long, value double")


@pytest.fixture
def skewed():
    """A third of all rows share one value; the rest is continuous with small ties."""
    rng = np.random.default_rng(3)
    data = np.concatenate([np.zeros(1000), np.round(rng.normal(0, 5, 2000), 2)])
    rng.shuffle(data)
    return data


@pytest.fixture
def many_buckets(monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 20)


def test_average_rank_of_ties(spark):
    got = ranks.average_ranks(values(spark, [1, 1, 2]), ["id"]).orderBy("id").collect()
    assert [r["rank"] for r in got] == [1.5, 1.5, 3]


def test_ranks_with_a_heavy_value(spark, skewed, many_buckets):
    got = ranks.average_ranks(values(spark, skewed), ["id"]).orderBy("id").toPandas()["rank"]
    assert got.tolist() == pd.Series(skewed).rank().tolist()


def test_no_sorted_bucket_is_above_the_limit(spark, skewed, monkeypatch):
    """Whatever the limit, only buckets of a single value hold more rows, and ranks stay exact."""
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 3)
    monkeypatch.setattr(ranks, "CUTS", 7)
    placed = ranks.place(values(spark, skewed))
    sizes = placed.sizes.withColumn("single", F.element_at("bucket", -1) % 2 == 1)
    assert sizes.filter("n > 3 and not single").count() == 0 and sizes.filter("n >= 1000 and single").count() == 1
    assert sizes.agg(F.max(F.size("bucket"))).first()[0] > 2
    got = ranks.average_ranks(values(spark, skewed), ["id"]).orderBy("id").toPandas()["rank"]
    assert got.tolist() == pd.Series(skewed).rank().tolist()


def gapped(n=700):
    rng = np.random.default_rng(8)
    base = rng.normal(size=n)
    frame = pd.DataFrame({
        "a": base, "b": np.round(base + rng.normal(size=n), 1), "heavy": np.where(rng.random(n) < 0.4, 0.0, base ** 2),
        "gap": np.where(rng.random(n) < 0.2, np.nan, -base), "one": 1.0})
    frame["same_gap"] = np.where(frame["gap"].isna(), np.nan, rng.random(n))
    frame["other_gap"] = np.where(rng.random(n) < 0.5, np.nan, np.round(base))
    frame["two"] = np.where(np.arange(n) < 2, np.arange(n), np.nan)
    return frame


@pytest.mark.parametrize("cuts,rows,bits", [(64, 500_000, 14), (4, 30, 5), (8, 1, 3)])
def test_spearman_of_pairs_with_gaps(spark, monkeypatch, cuts, rows, bits):
    """As pandas has it: ranks over the rows where both columns are present."""
    monkeypatch.setattr(rank_matrix, "CUTS", cuts)
    monkeypatch.setattr(rank_matrix, "ROWS_PER_BUCKET", rows)
    monkeypatch.setattr(rank_matrix, "BLOCK_BITS", bits)
    monkeypatch.setattr(rank_matrix, "HELD", 900)
    frame = gapped()
    cols = list(frame.columns)
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), ", ".join(f"{c} double" for c in cols)).repartition(3)
    assert sorted(map(sorted, rank_matrix.same_gaps(df, cols))) == [["a", "b", "heavy", "one"], ["gap", "same_gap"], ["other_gap"], ["two"]]
    got = {(r.a, r.b): (r.r, r.n) for r in rank_matrix.spearman_matrix(df, cols).collect()}
    want = frame.corr("spearman")
    for a in cols:
        for b in cols:
            both = frame[[a, b]].dropna() if a != b else frame[[a]].dropna()
            if len(both) < 2:
                assert (a, b) not in got
                continue
            assert got[a, b][1] == len(both)
            if np.isnan(want.loc[a, b]):
                assert got[a, b][0] is None
            else:
                assert got[a, b][0] == pytest.approx(want.loc[a, b], abs=1e-12)


def test_no_sorted_bucket_of_the_matrix_is_above_the_limit(spark, skewed, monkeypatch):
    monkeypatch.setattr(rank_matrix, "ROWS_PER_BUCKET", 25)
    monkeypatch.setattr(rank_matrix, "CUTS", 6)
    df = values(spark, skewed).select("value", F.col("id").alias("_row"))
    cuts = rank_matrix._cuts_of(df, ["value"])
    counts = rank_matrix._counts(df, ["value"], cuts)
    while (counts[0][::2] > 25).any():
        cuts = rank_matrix._cut_again(df, ["value"], cuts, counts)
        counts = rank_matrix._counts(df, ["value"], cuts)
    assert counts[0].sum() == 3000 and counts[0][::2].max() <= 25 and counts[0][1::2].max() >= 1000


def test_sample_and_folds_of_any_order(spark, monkeypatch):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("label"), ((F.col("id") * 7919) % 5003).alias("o"))
    monkeypatch.setattr(explore, "SAMPLE_BUCKETS", 4)
    got = [r.o for r in explore.seeded_sample(df, 700, ["id"], order=F.col("o")).collect()]
    assert sorted(got) == sorted(r.o for r in df.collect())[:700]
    assert explore.seeded_sample(df, 9000, ["id"]).count() == 5000 and explore.seeded_sample(df, 0, ["id"]).count() == 0
    monkeypatch.setattr(explore, "FOLD_BUCKET_ROWS", 50)
    rows = explore.stratified_folds(df, F.col("o"), 3).orderBy("label", "o").collect()
    assert all(r.fold == i % 3 for label in range(3) for i, r in enumerate(x for x in rows if x.label == label))


def test_p_values_follow_the_t_distribution(spark):
    """Two-sided values of t with 58 degrees of freedom, from tables."""
    df = spark.createDataFrame([(t, (t * t / (58 + t * t)) ** 0.5) for t in (1.0, 1.671553, 2.001717, 2.663287, 3.466329)], "t double, r double")
    got = [r[0] for r in df.select(F.exp(explore.log_p_value(F.col("r"), F.lit(60)))).collect()]
    np.testing.assert_allclose(got[1:], [0.1, 0.05, 0.01, 0.001], rtol=5e-3)


def test_quantiles_with_a_heavy_value(spark, skewed, many_buckets):
    probs = [0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.99, 1]
    got = ranks.quantiles(values(spark, skewed), probs).orderBy("prob").toPandas()["quantile"]
    np.testing.assert_allclose(got, np.quantile(skewed, probs), atol=1e-12)


def test_cumulative_counts_and_cdf(spark, skewed, many_buckets):
    got = dist.empirical_cdf(values(spark, skewed)).orderBy("value").toPandas()
    want = pd.Series(skewed).value_counts(normalize=True).sort_index().cumsum()
    np.testing.assert_allclose(got["cdf"], want)


def test_percentile_table(spark):
    assert dist.percentile_table(values(spark, range(10))).first()["p99"] == pytest.approx(8.91)


def test_shares_count_outside_values_in_the_denominator(spark):
    r = dist.share_table(values(spark, [0, 0.5, 0.51, 5, 6])).first()
    assert [r[i] for i in range(1, 8)] == pytest.approx([0.2, 0.2, 0.2, 0, 0, 0, 0.2])


def test_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    assert ranks.auc(df).first()["auc"] == 0.75


def test_last_edge_is_closed(spark):
    got = dist.edge_histogram(values(spark, [5.25, -0.25, 0.25]), "value", -0.25, 0.5, 11).orderBy("bin").collect()
    assert (got[10]["count"], got[0]["count"], got[1]["count"]) == (1, 1, 1) and len(got) == 11


def test_histogram_matches_numpy(spark, skewed):
    got = dist.histogram(values(spark, skewed), "value", 13).orderBy("bin").toPandas()["count"]
    assert got.tolist() == np.histogram(skewed, 13)[0].tolist()
    flat = dist.histogram(values(spark, [4, 4]), "value", 4).orderBy("bin").toPandas()["count"]
    assert flat.tolist() == np.histogram([4, 4], 4)[0].tolist()


def test_box_stats(spark, skewed, many_buckets):
    r = dist.box_stats(values(spark, skewed)).first()
    q1, q3 = np.quantile(skewed, [0.25, 0.75])
    inside = skewed[(skewed >= q1 - 1.5 * (q3 - q1)) & (skewed <= q3 + 1.5 * (q3 - q1))]
    assert (r["whisker_low"], r["whisker_high"], r["outliers"]) == (inside.min(), inside.max(), len(skewed) - len(inside))


def test_density_integrates_to_one(spark, skewed):
    d = dist.density(values(spark, skewed), 201, factor=0.3).orderBy("j").toPandas()
    assert np.trapezoid(d["density"], d["x"]) == pytest.approx(1, abs=1e-3)


def test_correlations_use_the_rows_both_columns_have(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(rng.normal(1000, 1, (200, 3)), columns=list("abc"))
    pdf["c"] += pdf["a"]
    pdf.loc[::7, "b"] = np.nan
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "abc"])
    got = explore.correlation_matrix(df, list("abc")).toPandas().pivot(index="a", columns="b", values="r")
    np.testing.assert_allclose(got.to_numpy(), pdf.corr().to_numpy(), atol=1e-9)


def test_spearman_matrix(spark, skewed, many_buckets):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"region_id": 1, "week_idx": np.arange(len(skewed)), "a": skewed, "b": np.exp(skewed / 5) + rng.normal(0, 1, len(skewed))})
    got = explore.spearman_matrix(spark.createDataFrame(pdf), ["a", "b"], ["region_id", "week_idx"])
    r = got.filter("a = 'a' and b = 'b'").first()["r"]
    assert r == pytest.approx(pdf[["a", "b"]].rank().corr().iloc[0, 1])


def test_no_windows_left(spark):
    df = spark.createDataFrame([(1, i) for i in range(15)], "region_id long, week_idx long")
    assert explore.available_windows(df).first()["windows"] == 0


def test_stratified_folds_are_even(spark):
    df = spark.createDataFrame([(1, i, int(i % 10 == 0)) for i in range(300)], "region_id long, week_idx long, label int")
    out = explore.stratified_folds(df, F.pmod(F.xxhash64("week_idx"), F.lit(10 ** 6)), 3)
    assert {r["count"] for r in out.groupBy("label", "fold").count().filter("label = 1").collect()} == {10}


def test_seeded_sample_is_repeatable(spark):
    df = spark.createDataFrame([(1, i) for i in range(100)], "region_id long, week_idx long")
    take = lambda seed: {r[1] for r in explore.seeded_sample(df, 10, ["region_id", "week_idx"], seed).collect()}
    assert take(1) == take(1) and take(1) != take(2) and len(take(1)) == 10


def test_adversarial_sees_a_shift(spark):
    rng = np.random.default_rng(0)
    frame = lambda shift: spark.createDataFrame(
        [(1, i, float(v), float(u)) for i, (v, u) in enumerate(zip(rng.normal(shift, 1, 300), rng.normal(0, 1, 300)))],
        "region_id long, week_idx long, moved double, still double")
    s = hurdle.TreeSettings(rounds=5, depth=2, step=0.3, min_rows=5, features="all", subsample=1.0)
    scored, nodes = hurdle.adversarial(frame(0), frame(3), ["moved", "still"], s)
    assert hurdle.adversarial_summary(scored).first()["shift"] == "high"
    counts = hurdle.split_counts(nodes, ["moved", "still", "unused"])
    top = hurdle.top_importances(counts).collect()
    assert top[0]["feature"] == "moved" and (top[-1]["feature"], top[-1]["importance"], top[-1]["gain"]) == ("unused", 0, 0)
    rows = nodes.collect()
    assert {r.model for r in rows} == {"fold0", "fold1", "fold2"}
    assert sum(r["importance"] for r in top) * 3 == pytest.approx(sum(r.feature is not None for r in rows))
    checks = hurdle.tree_checks(nodes).collect()
    assert all(c.broken == 0 and c.least_rows >= 5 and c.nodes == 2 * c.leaves - c.trees for c in checks)


def test_files(spark, tmp_path):
    wide = spark.createDataFrame([(1, 0.0, 2.0)], "region_id long, pred_week1 double, pred_week2 double")
    path = tables.write_submission(wide, str(tmp_path), "SOFT")
    got = tables.read_submissions(spark, {"a": path, "b": str(tmp_path / "absent")})
    assert sorted(tuple(r) for r in got.collect()) == [("a", 0.0), ("a", 2.0)]
    with pytest.raises(ValueError):
        tables.write_panel(wide, str(tmp_path / "x"), "feather")
    tables.export_processed(wide, wide, str(tmp_path / "p"), "csv")
    train, _, stats = tables.read_processed(spark, str(tmp_path / "p"), "csv")
    assert train.count() == 1 and stats is None


def test_csv_blanks_and_nan_are_missing(spark, tmp_path):
    from fieldloom.sources.panel import read_panel_csv
    (tmp_path / "d.csv").write_text("region_id,date,prec,tmp\n1,1-01-01,NaN,\n1,1-01-02,1.5,2\n")
    rows = read_panel_csv(spark, str(tmp_path / "d.csv")).orderBy("date").collect()
    assert [(r["prec"], r["tmp"]) for r in rows] == [(None, None), (1.5, 2.0)]
