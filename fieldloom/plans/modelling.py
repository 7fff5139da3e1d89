"""Weekly panels to out-of-fold errors and forecasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..constants import PANEL_FEATURES
from ..operators import encoding, ensemble, hurdle, windows
from ..operators.impute import present
from ..session import stage


@dataclass
class Samples:
    """Window samples per fold (with encodings) and the test windows per fold."""

    weekly: DataFrame
    folded: DataFrame
    test: DataFrame
    features: list[str]


def build_samples(train: DataFrame, test: DataFrame, keep=stage, keep_weeks=stage, whole: bool = False) -> Samples:
    """``keep`` is applied to the windows, which are many times the weeks (see ``preprocess.as_is``), ``keep_weeks`` to these.
    ``whole``: regions are short (see ``windows.renumber``)."""
    ready = windows.refine(train, True).dropna(subset=["score"])
    features = present(PANEL_FEATURES, ready)
    weekly = keep_weeks(windows.renumber(ready.select("region_id", "week_idx", "score", *features), whole), "scored_weeks")
    samples = keep(windows.sliding_windows(weekly, features), "windows")
    members = windows.split_folds(samples.select("region_id", "start", "tgt_start", "tgt_end"), weekly)
    scores = windows.fold_training_scores(weekly, members)
    learnt = stage(encoding.fit_encoding(scores), "encoding")
    last = windows.last_windows(windows.refine(test, False), features)
    ready = keep(encoding.with_encodings(samples, learnt, row="start"), "encoded-windows")
    return Samples(
        weekly, encoding.pick_encoding(windows.split_folds(ready, weekly)),
        stage(encoding.per_fold(last, learnt), "test-windows"), features)


@dataclass
class Trained:
    out_of_fold: DataFrame
    predictions: DataFrame
    by_horizon: DataFrame
    overall: DataFrame
    binned: DataFrame


def train(samples: Samples, settings: hurdle.HurdleSettings | None = None, model_folder: str | None = None) -> Trained:
    held, ahead = hurdle.train_hurdle(samples.folded, samples.test, settings, model_folder=model_folder)
    held = ensemble.gate_out_of_fold(held)
    by_horizon = ensemble.horizon_errors(held)
    return Trained(
        held, ahead, by_horizon,
        ensemble.overall_error(ensemble.fold_errors(by_horizon)), ensemble.binned_errors(held))


def infer(predictions: DataFrame, mode: str = "HARD", threshold: float = 0.5, rounding: bool = True) -> DataFrame:
    """Raw fold predictions to the wide forecast, one row per region."""
    merged = ensemble.ensemble(predictions)
    return ensemble.wide_forecast(ensemble.forecast(merged, mode, threshold, rounding))


def best_threshold(out_of_fold: DataFrame, candidates: list[float]) -> DataFrame:
    """MAE of hard gating at each candidate threshold, best first: one pass."""
    wide = out_of_fold.agg(*[
        F.avg(F.abs(ensemble.hard_gate(F.col("pred_a"), F.col("prob_b"), t) - F.col("y_true"))).alias(f"m{i}")
        for i, t in enumerate(candidates)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"m{i}").alias("mae"))
                     for i, t in enumerate(candidates)])
    return wide.select(F.inline(rows)).orderBy("mae", "threshold")
