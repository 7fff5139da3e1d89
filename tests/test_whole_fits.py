"""Models learn from all rows, whether a task holds them or all tasks work on them together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.checks import catalog
from fieldloom.operators import boosting, hurdle

S = hurdle.TreeSettings(rounds=6, patience=3, depth=3, step=0.4, min_rows=20, features="all", subsample=1.0)


def windows(spark, n=5000):
    a, b = F.rand(1), F.rand(2)
    rows = spark.range(n, numPartitions=3).select("id", a.alias("a"), b.alias("b")).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1))))
    y = F.when(F.col("a") > 0.5, 1 + 3 * F.col("b")).otherwise(0.0)
    return rows.select(
        "fold", F.col("id").alias("region_id"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"),
        F.col("id").alias("start"), F.array("a", "b").cast("array<float>").alias("x"), F.array(y, F.lit(0.0)).cast("array<float>").alias("y"))


@pytest.mark.parametrize("cells", [boosting.TASK_CELLS, 0])
def test_a_fold_learns_from_all_its_windows(spark, tmp_path, monkeypatch, cells):
    monkeypatch.setattr(boosting, "TASK_CELLS", cells)
    samples, folder = windows(spark).cache(), str(tmp_path / "models")
    test = samples.filter("region_id < 10").select("fold", "region_id", "x")
    held, ahead = hurdle.train_hurdle(samples, test, hurdle.HurdleSettings(S, S, most_rows=catalog.LABELLED), horizon=2, model_folder=folder)
    nodes = hurdle.load_nodes(spark, folder)
    assert [tuple(r) for r in nodes.filter("tree = 0").groupBy("part").agg(F.min("rows"), F.max("rows"), F.count("*")).orderBy("part").collect()] == [
        ("occurrence", 4000, 4000, 4), ("severity", 4000, 4000, 4)]
    assert nodes.filter("tree > 0 and node = 0 and horizon = 1").agg(F.min("rows")).first()[0] == 4000
    checks = hurdle.tree_checks(hurdle.named_nodes(nodes)).collect()
    assert len(checks) == 8 and all(c.broken == 0 and c.nodes == 2 * c.leaves - c.trees for c in checks)
    errors = held.filter("horizon = 1").agg(F.avg(F.abs(F.col("pred_a") - F.col("y_true"))), F.avg("y_true"), F.avg(
        (F.col("prob_b") > 0.5).cast("int") - (F.col("y_true") > 0).cast("int"))).first()
    assert held.count() == 2 * 2 * 1000 and errors[0] < 0.6 * errors[1] and abs(errors[2]) < 0.02
    assert ahead.filter("horizon = 2 and (prob_b <> 0 or pred_a <> 0)").count() == 0
    assert sorted(hurdle.predict_nodes(nodes, test, 2).collect()) == sorted(ahead.collect())


@pytest.mark.parametrize("cells", [boosting.TASK_CELLS, 0])
def test_adversarial_learns_from_all_rows(spark, monkeypatch, cells):
    monkeypatch.setattr(boosting, "TASK_CELLS", cells)
    n = 160_000  # more than 50,000 of a fold and cohort
    frame = lambda rows, shift: spark.range(rows).select(
        F.col("id").alias("region_id"), F.lit(0).cast("long").alias("week_idx"), (F.rand(3) + shift).alias("moved"), F.rand(4).alias("still"))
    settings = hurdle.TreeSettings(rounds=10, depth=2, step=0.5, min_rows=20, features="all", subsample=1.0)
    scored, nodes = hurdle.adversarial(frame(n, 0), frame(30_000, 0.4), ["moved", "still"], settings)
    whole = scored.count()
    assert whole == n + 30_000
    assert sum(r["rows"] for r in nodes.filter("tree = 0").collect()) == 2 * whole
    assert sum(r["rows"] for r in nodes.filter("tree = 1 and node = 0").collect()) == 2 * whole
    by = {r["label"]: r["s"] for r in scored.groupBy("label").agg(F.avg("score").alias("s")).collect()}
    assert by[1.0] > by[0.0]


def test_cuts_come_from_all_rows(spark, monkeypatch):
    n = 30_000
    df = spark.range(n, numPartitions=5).select(F.lit(0).alias("g"), "id", F.array(
        F.rand(1), F.when(F.col("id") % 3 > 0, F.randn(2)), F.lit(1.0)).alias("x")).cache()
    x = np.array([r["x"] for r in df.collect()], dtype=np.float64)
    exact = []
    for c in x.T:
        known = c[~np.isnan(c)]
        q = np.unique(np.quantile(known, np.arange(1, 32) / 32, method="lower"))
        exact.append(q[q < known.max()])
    found = boosting.feature_cuts(df, "g", ["id"], 32)[0]
    assert all(np.array_equal(a, b) for a, b in zip(found, exact, strict=True))
    assert all(np.array_equal(a, b) for a, b in zip(boosting.feature_cuts(df.repartition(3), "g", ["id"], 32)[0], exact))
    monkeypatch.setattr(boosting, "TASK_CELLS", 0)
    near = boosting.feature_cuts(df, "g", ["id"], 32)[0]
    share = lambda c, q: np.searchsorted(np.sort(c[~np.isnan(c)]), q) / (~np.isnan(c)).sum()
    assert [len(q) for q in near] == [31, 31, 0]
    assert all(np.abs(share(c, a) - share(c, b)).max() < 3e-4 for c, a, b in zip(x.T[:2], near, exact))
