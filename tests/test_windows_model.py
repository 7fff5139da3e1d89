import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import encoding, ensemble, hurdle, windows


def panel_of(spark, lengths, skip=()):
    rows = [(r, i, i, float(i % 6), float(i), float(r)) for r, n in lengths.items() for i in range(n) if (r, i) not in skip]
    df = spark.createDataFrame(rows, "region_id long, week_idx long, pos long, score double, a double, b double")
    return windows.renumber(df.drop("pos"))


def test_number_of_windows(spark):
    df = panel_of(spark, {1: 17, 2: 18, 3: 19})
    got = {r[0]: r[1] for r in windows.sliding_windows(df, ["a", "b"]).groupBy("region_id").count().collect()}
    assert got == {2: 1, 3: 2}


def test_windows_across_chunks(spark, monkeypatch):
    from fieldloom.operators import splits
    monkeypatch.setattr(splits, "CHUNK_WEEKS", 16)
    out = {(r["region_id"], r["start"]): r for r in windows.sliding_windows(panel_of(spark, {1: 70, 2: 20}), ["a", "b"]).collect()}
    assert len(out) == 53 + 3
    for (region, start), r in out.items():
        want = [v for i in range(start, start + 13) for v in (float(i), float(region))] + [12.0, 0.0]
        assert r["x"] == want
        assert r["y"] == [float(i % 6) for i in range(start + 13, start + 18)]


def test_windows_count_rows_not_weeks(spark):
    df = panel_of(spark, {1: 20}, skip={(1, 5)})
    first = windows.sliding_windows(df, ["a"]).orderBy("start").first()
    assert first["x"][4:7] == [4.0, 6.0, 7.0] and first["tgt_start"] == 14


def test_short_history_repeats_its_first_row(spark):
    df = spark.createDataFrame([(1, 0, 3.0), (1, 1, 5.0)], "region_id long, week_idx long, a double")
    assert windows.last_windows(df, ["a"]).first()["x"] == [3.0] * 12 + [5.0, 2.0]


def test_region_without_a_validation_week_still_trains(spark):
    df = panel_of(spark, {1: 60, 2: 60}, skip={(2, 57)})
    folded = windows.split_folds(windows.sliding_windows(df, ["a"]), df, folds=1)
    got = {(r[0], r[1]): r[2] for r in folded.groupBy("region_id", "split").count().collect()}
    assert got[1, "val"] == 1 and (2, "val") not in got and got[2, "train"] > 0
    assert folded.filter("split = 'train'").agg(F.max("tgt_end")).first()[0] == 54


def test_flat_names():
    names = windows.flat_names(["a", "b"])
    assert len(names) == 28 and names[:3] == ["a_w1", "b_w1", "a_w2"] and names[-1] == "b_delta"


def test_fallback_weights_regions_equally(spark):
    rows = [(0, 1, 1.0)] * 2 + [(0, 2, 3.0)] * 8
    enc = encoding.fit_encoding(spark.createDataFrame(rows, "fold int, region_id long, score double"))
    assert encoding.encoding_fallback(enc).first()["_region_mean_score"] == 2
    new = spark.createDataFrame([(0, 9)], "fold int, region_id long")
    assert encoding.attach_encoding(new, enc).first()["region_mean_score"] == 2


def test_flat_width_with_encoding(spark):
    df = spark.createDataFrame([([float(i) for i in range(420)], 0.5, 0.25)], "x array<float>, region_mean_score double, region_zero_prob double")
    x = encoding.flat_with_encoding(df, 30).first()["x"]
    assert len(x) == 448 and x[29:33] == [29.0, 0.5, 0.25, 30.0] and x[-2:] == [0.0, 0.0]


def test_gates(spark):
    df = spark.createDataFrame([(1, 1, 2.0, 0.5), (2, 1, 2.0, 0.49), (3, 1, 2.0, None)], "region_id long, horizon int, severity double, prob double")
    assert [r["pred"] for r in ensemble.forecast(df).orderBy("region_id").collect()] == [2, 0, 2]
    with pytest.raises(ValueError):
        ensemble.forecast(df, "OTHER")


def test_bounds_and_rounding(spark):
    df = spark.createDataFrame([(i, 1, v, 1.0) for i, v in enumerate([0.5, 1.5, 2.5, 5.4, -0.2])], "region_id long, horizon int, severity double, prob double")
    assert [r["pred"] for r in ensemble.forecast(df).orderBy("region_id").collect()] == [0, 2, 2, 5, 0]


def test_median_over_folds(spark):
    df = spark.createDataFrame([(f, 1, 1, v, 0.5) for f, v in enumerate([0.0, 1.0, 3.0, 10.0])], "fold int, region_id long, horizon int, pred_a double, prob_b double")
    assert ensemble.ensemble(df).first()["severity"] == 2


def test_empty_interval_keeps_its_row(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, 4.5, 4.0)], "fold int, y_true double, pred double")
    rows = {r["bin"]: r for r in ensemble.binned_errors(df).collect()}
    assert len(rows) == 6 and rows["3-4"]["n"] == 0 and rows["3-4"]["mae"] is None and rows["4-5"]["mae"] == 0.5


def test_hurdle_learns_and_handles_one_class(spark):
    rng = np.random.default_rng(1)
    rows = []
    for fold in (0, 1):
        for i in range(300):
            a, b = rng.random(2)
            y = [float(a > 0.5) * float(1 + 3 * b), 0.0]
            rows.append((fold, i, "val" if i % 5 == 0 else "train", i, [float(a), float(b)], y))
    samples = spark.createDataFrame(rows, "fold int, region_id long, split string, start long, x array<float>, y array<float>")
    test = samples.filter("region_id < 10").select("fold", "region_id", "x")
    s = hurdle.TreeSettings(rounds=5, depth=3, step=0.5, min_rows=5, features="all", subsample=1.0)
    held, ahead = hurdle.train_hurdle(samples, test, hurdle.HurdleSettings(s, s), horizon=2)
    gated = ensemble.gate_out_of_fold(held)
    mae = {r["horizon"]: r["mae"] for r in ensemble.horizon_errors(gated).filter("fold = 0").collect()}
    zero = held.filter("horizon = 1").agg(F.avg(F.abs("y_true"))).first()[0]
    assert mae[1] < 0.6 * zero and mae[2] == 0
    assert ahead.filter("horizon = 2 and prob_b <> 0").count() == 0 and ahead.count() == 2 * 2 * 10


def test_best_round_waits_for_patience():
    assert hurdle.best_round([5, 4, 3, 3, 3, 2], 3) == 6 and hurdle.best_round([5, 4, 3, 3, 3, 2], 2) == 3
    assert hurdle.best_round([1.0], 5) == 1 and hurdle.best_round([2, 3, 4], 1) == 1


def test_default_step_boosts_beyond_one_tree_and_beats_constants(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(800):
        a, b = rng.random(2)
        rows.append((i % 4 == 0, [float(a), float(b)], float((a > 0.4) * (1 + 3 * b))))
    frame = vectors(spark, rows)
    default = hurdle.TreeSettings()
    s = hurdle.TreeSettings(rounds=25, depth=3, min_rows=10, features="all", step=default.step, patience=default.patience)
    model = hurdle.fit_severity(frame, s)
    assert model.getNumTrees > 1
    held = model.transform(frame.filter("is_val")).toPandas()
    y, middle = held["y"], frame.filter("not is_val").toPandas()["y"].median()
    error = (held["pred_a"] - y).abs().mean()
    assert error < y.abs().mean() and error < (y - middle).abs().mean()
    assert hurdle.fit_occurrence(frame.withColumn("occurs", (F.col("y") > 0).cast("double")), s).getNumTrees > 1


def noisy(spark, n=900, seed=7):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.random(3)
        rows.append((i % 3 == 0, [float(a), float(b), float(c)], float(max(0.0, (a > 0.5) * (1 + b) + rng.normal(0, 0.4)))))
    return vectors(spark, rows)


@pytest.mark.parametrize("part", ["severity", "occurrence"])
def test_first_trees_predict_like_a_fit_of_as_many_rounds(spark, part, tmp_path):
    frame = noisy(spark).withColumn("occurs", (F.col("y") > 0.8).cast("double"))
    none = frame.filter("not is_val").withColumn("is_val", F.lit(False))
    fit = hurdle.fit_severity if part == "severity" else hurdle.fit_occurrence
    s = hurdle.TreeSettings(rounds=12, depth=3, step=0.3, min_rows=5, subsample=0.7)
    short = hurdle.first_trees(fit(none, s), 5)
    other = fit(none, hurdle.TreeSettings(rounds=5, depth=3, step=0.3, min_rows=5, subsample=0.7))
    path = str(tmp_path / "short")
    short.write().overwrite().save(path)
    again = type(short).load(path)
    col = "pred_a" if part == "severity" else "_raw"
    rows = lambda m: [r[0] for r in m.transform(frame).select(col).collect()]
    assert short.getNumTrees == again.getNumTrees == 5 and rows(short) == rows(other) == rows(again)
    assert hurdle.first_trees(other, 9) is other


def test_rounds_double_until_the_patience_has_passed(spark):
    frame, made = noisy(spark), []

    def make(rounds):
        made.append(rounds)
        return hurdle.GBTRegressor(labelCol="y", maxIter=rounds, maxDepth=4, stepSize=0.5, seed=1, predictionCol="pred_a")

    s = hurdle.TreeSettings(rounds=64, first=4, patience=3)
    model = hurdle._boosted(make, frame, s, lambda m, val: m.evaluateEachIteration(val, "squared"))
    errors = make(64).fit(frame.filter("not is_val")).evaluateEachIteration(frame.filter("is_val"), "squared")
    best = hurdle.best_round(errors, 3)
    assert model.getNumTrees == best < 32
    assert made[:-1] == [4 * 2 ** i for i in range(len(made) - 1)] and best + 3 <= made[-2] < 2 * (best + 3) or made[-2] == 4


def test_labelled_rows_are_bounded(spark):
    rows = [(0, i, "val" if i >= 90 else "train", i, [float(i)], [1.0]) for i in range(100)]
    samples = spark.createDataFrame(rows, "fold int, region_id long, split string, start long, x array<float>, y array<float>")
    got = hurdle._fold_rows(samples, 0, 20)
    assert got.filter("is_val").count() == 10 and got.filter("not is_val").count() == 20 and got.rdd.getNumPartitions() == 1
    assert sorted(hurdle._fold_rows(samples, 0, 20).collect()) == sorted(got.collect())
    assert hurdle._fold_rows(samples, 0, None).count() == 100


def vectors(spark, rows):
    from pyspark.ml.functions import array_to_vector
    return spark.createDataFrame(rows, "is_val boolean, x array<double>, y double").withColumn("features", array_to_vector("x")).cache()


def test_no_exchange_carries_windows_by_fold(spark):
    """Windows are joined with the encodings by region, before they are copied into folds."""
    w = spark.createDataFrame([(1, 0, [1.0, 2.0], [0.0], 20, 24)], "region_id long, start long, x array<float>, y array<float>, tgt_start long, tgt_end long")
    weekly = spark.createDataFrame([(1, 60, 0.0)], "region_id long, week_idx long, score double")
    enc = spark.createDataFrame([(f, 1, 1.0, 0.5) for f in range(4)], "fold int, region_id long, region_mean_score double, region_zero_prob double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folded = encoding.pick_encoding(windows.split_folds(encoding.with_encodings(w, enc, "start"), weekly))
        plan = folded._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate explode") < plan.index("Join")  # the copies are made above the join
        assert {r.fold for r in folded.collect()} == {0, 1, 2} and folded.first().region_mean_score == 1.0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
