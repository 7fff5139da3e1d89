"""The bounded adversarial check stores its features once; only numbers of rows are dealt and joined."""

from pyspark.sql import functions as F

from fieldloom.operators import hurdle


def test_features_are_stored_once(spark, monkeypatch):
    frame = lambda shift: spark.range(900).select(
        (F.col("id") % 30).alias("region_id"), (F.col("id") / 30).cast("long").alias("week_idx"),
        (F.rand(3) + shift).alias("moved"), F.rand(4).alias("still"))
    stored, usual = {}, hurdle.stage

    def stage(df, label):
        stored[label] = df.columns
        return usual(df, label)
    monkeypatch.setattr(hurdle, "stage", stage)
    settings = hurdle.TreeSettings(rounds=8, depth=2, min_rows=20, features="all", subsample=1.0)
    # One row twice: rows are told apart by their number and not by their keys.
    twice = frame(0).unionByName(frame(0).filter("region_id = 1 and week_idx = 1"))
    scored, _ = hurdle.adversarial(twice, frame(3), ["moved", "still"], settings, most_rows=100)
    assert [label for label, cols in stored.items() if "moved" in cols] == ["adversarial"]
    assert scored.count() == 1801 and scored.columns == ["region_id", "week_idx", "fold", "label", "score"]
    sizes = [r["n"] for r in scored.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [300, 300, 300, 300, 300, 301]
    assert hurdle.adversarial_summary(scored).first()["shift"] == "high"
