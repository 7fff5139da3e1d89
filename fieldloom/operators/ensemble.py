"""Gating, fold ensemble, error tables and the wide forecast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import HORIZON, SEVERITY_BINS
from ..functions.scalars import bounded_score, in_bin
from .splits import KEY


def hard_gate(severity: Column, prob: Column, threshold: float = 0.5) -> Column:
    """0 below the threshold; a probability on it, or a missing one, keeps the severity."""
    return F.when(prob < threshold, F.lit(0.0)).otherwise(severity)


def soft_gate(severity: Column, prob: Column) -> Column:
    return severity * prob


def gate_out_of_fold(preds: DataFrame, threshold: float = 0.5) -> DataFrame:
    return preds.withColumn("pred", hard_gate(F.col("pred_a"), F.col("prob_b"), threshold))


def horizon_errors(preds: DataFrame) -> DataFrame:
    """MAE per fold and horizon."""
    return preds.groupBy("fold", "horizon").agg(F.avg(F.abs(F.col("pred") - F.col("y_true"))).alias("mae"))


def fold_errors(by_horizon: DataFrame) -> DataFrame:
    return by_horizon.groupBy("fold").agg(F.avg("mae").alias("mae"))


def overall_error(by_fold: DataFrame) -> DataFrame:
    """Mean over folds and its population sd."""
    return by_fold.agg(F.avg("mae").alias("cv_mae"), F.stddev_pop("mae").alias("cv_sd"))


def binned_errors(preds: DataFrame) -> DataFrame:
    """Count, mean truth, mean forecast and MAE per fold and score interval.

    An interval nobody falls into keeps its row, with count 0 and no means.
    """
    truth = F.col("y_true")
    aggs = []
    for i, (_, low, high) in enumerate(SEVERITY_BINS):
        hit = in_bin(truth, low, high)
        aggs += [
            F.count(F.when(hit, 1)).alias(f"n{i}"), F.avg(F.when(hit, truth)).alias(f"t{i}"),
            F.avg(F.when(hit, F.col("pred"))).alias(f"p{i}"),
            F.avg(F.when(hit, F.abs(F.col("pred") - truth))).alias(f"e{i}"),
        ]
    wide = preds.groupBy("fold").agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(label).alias("bin"), F.col(f"n{i}").alias("n"), F.col(f"t{i}").alias("avg_true"),
                 F.col(f"p{i}").alias("avg_pred"), F.col(f"e{i}").alias("mae"))
        for i, (label, _, _) in enumerate(SEVERITY_BINS)])
    return wide.select("fold", F.inline(rows))


def prediction_ranges(preds: DataFrame) -> DataFrame:
    return preds.groupBy("fold").agg(
        F.min("prob_b").alias("prob_min"), F.max("prob_b").alias("prob_max"),
        F.min("pred_a").alias("pred_min"), F.max("pred_a").alias("pred_max"))


def across_folds(preds: DataFrame, horizon: int = 1) -> DataFrame:
    """How the folds disagree about the first region at one horizon."""
    first = preds.agg(F.min(KEY)).scalar()
    return preds.filter((F.col(KEY) == first) & (F.col("horizon") == horizon)).select(
        KEY, "fold", "horizon", "pred_a", "prob_b")


def ensemble(preds: DataFrame) -> DataFrame:
    """Median severity and mean probability over folds."""
    return preds.groupBy(KEY, "horizon").agg(
        F.median("pred_a").alias("severity"), F.avg("prob_b").alias("prob"))


def forecast(
    merged: DataFrame, mode: str = "HARD", threshold: float = 0.5, rounding: bool = True,
) -> DataFrame:
    """Gate, bound to [0, 5] and round half to even."""
    severity, prob = F.col("severity"), F.col("prob")
    if mode.upper() == "SOFT":
        gated = soft_gate(severity, prob)
    elif mode.upper() == "HARD":
        gated = hard_gate(severity, prob, threshold)
    else:
        raise ValueError(f"unknown gating mode {mode!r}")
    final = bounded_score(gated)
    return merged.select(KEY, "horizon", (F.rint(final) if rounding else final).alias("pred"))


def wide_forecast(long: DataFrame, horizon: int = HORIZON) -> DataFrame:
    weeks = list(range(1, horizon + 1))
    wide = long.groupBy(KEY).pivot("horizon", weeks).agg(F.first("pred"))
    return wide.select(KEY, *[F.col(str(h)).alias(f"pred_week{h}") for h in weeks])


def forecast_summary(merged: DataFrame, long: DataFrame) -> DataFrame:
    """Mean severity and probability before the gate, mean and exact-zero share after it."""
    after = long.agg(F.avg("pred").alias("mean_pred"), F.avg((F.col("pred") == 0).cast("double")).alias("zero_share"))
    before = merged.agg(F.struct(F.avg("severity").alias("s"), F.avg("prob").alias("p"))).scalar()
    return after.select(before["s"].alias("mean_severity"), before["p"].alias("mean_prob"), "mean_pred", "zero_share")
