"""Sliding windows over weeks, time-based folds and their training scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import FOLD_STEP, FOLDS, HORIZON, PANEL_FEATURES, WINDOW
from .clean import drop_unused
from .impute import drop_incomplete, fill_or_zero, present
from .splits import CHUNK, KEY, attach, chunk_window, dense_position, spread, trim, week_rows


def flat_names(features: list[str], window: int = WINDOW) -> list[str]:
    """Names of the flattened window: week by week, then last-minus-first."""
    weekly = [f"{c}_w{w}" for w in range(1, window + 1) for c in features]
    return weekly + [f"{c}_delta" for c in features]


def refine(weekly: DataFrame, is_train: bool) -> DataFrame:
    """Drop unused columns; train rows must be complete, test gaps are filled."""
    out = drop_unused(weekly)
    cols = present(PANEL_FEATURES, out)
    return drop_incomplete(out, cols) if is_train else fill_or_zero(out, cols)


def renumber(weekly: DataFrame, whole: bool = False) -> DataFrame:
    """Positions after rows were dropped; windows count rows, not calendar weeks.

    ``whole`` says that regions are short: each is numbered at once, and the rows are worked out once.
    """
    if whole:
        number = F.row_number().over(Window.partitionBy(KEY).orderBy("week_idx"))
        return weekly.withColumn("pos", (number - 1).cast("long"))
    return dense_position(weekly, ["week_idx"], F.floor(F.col("week_idx") / week_rows()))


def flatten_window(block: Column) -> Column:
    """Week-major values followed by the last week minus the first."""
    delta = F.zip_with(F.element_at(block, -1), F.element_at(block, 1), lambda a, b: a - b)
    return F.concat(F.flatten(block), delta)


def sliding_windows(
    weekly: DataFrame, features: list[str], window: int = WINDOW, horizon: int = HORIZON,
) -> DataFrame:
    """Every run of ``window`` rows with the scores of the next ``horizon`` rows.

    Expects ``pos``. Result: ``start`` (position of the first row), ``x`` (flat floats), ``y`` and
    the weeks in which the targets start and end.
    """
    rows = week_rows()
    vec = F.array(*[F.col(c).cast("float") for c in features])
    slim = weekly.select(KEY, "pos", "week_idx", "score", F.struct(vec.alias("v")).alias("_f"))
    w = chunk_window("pos")
    past, nxt = w.rowsBetween(-(window - 1), 0), w.rowsBetween(1, horizon)
    framed = spread(slim, "pos", rows, back=window - 1, ahead=horizon).select(
        KEY, CHUNK, (F.col("pos") - (window - 1)).alias("start"), "pos",
        F.collect_list("_f").over(past).alias("_past"),
        F.collect_list(F.struct("week_idx", "score")).over(nxt).alias("_next"),
        F.count(F.lit(1)).over(past).alias("_weeks"),  # so that readers without ``x`` need no features
    )
    whole = (F.col("_weeks") == window) & (F.size("_next") == horizon)
    block = F.col("_past.v")
    return trim(framed, "pos", rows).filter(whole).select(
        KEY, "start",
        flatten_window(block).alias("x"),
        F.transform("_next", lambda t: t["score"].cast("float")).alias("y"),
        F.element_at("_next", 1)["week_idx"].alias("tgt_start"),
        F.element_at("_next", -1)["week_idx"].alias("tgt_end"),
    )


def last_windows(test: DataFrame, features: list[str], window: int = WINDOW) -> DataFrame:
    """The last ``window`` rows per region; a short history repeats its first row in front."""
    newest = Window.partitionBy(KEY).orderBy(F.desc("week_idx"))
    vec = F.array(*[F.col(c).cast("float") for c in features])
    kept = test.select(KEY, "week_idx", vec.alias("v"), F.row_number().over(newest).alias("_rn")).filter(
        F.col("_rn") <= window)
    rows = kept.groupBy(KEY).agg(F.array_sort(F.collect_list(F.struct("week_idx", "v"))).alias("_w"))
    block = F.col("_w.v")
    short = F.array_repeat(F.element_at(block, 1), F.lit(window) - F.size("_w"))
    return rows.select(KEY, F.concat(short, block).alias("_b")).select(
        KEY, flatten_window(F.col("_b")).alias("x"))


def fold_bounds(weekly: DataFrame, folds: int = FOLDS, step: int = FOLD_STEP, horizon: int = HORIZON) -> DataFrame:
    """One row per fold: validation weeks and the last week training targets may reach."""
    top = weekly.agg(F.max("week_idx").alias("top"))
    val_end = F.col("top") - F.col("fold") * step
    return top.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).select(
        "fold", (val_end - horizon).alias("train_end"), (val_end - horizon + 1).alias("val_start"),
        val_end.alias("val_end"))


def split_folds(
    samples: DataFrame, weekly: DataFrame, folds: int = FOLDS, step: int = FOLD_STEP,
    horizon: int = HORIZON,
) -> DataFrame:
    """Copy each window into the folds that use it, marked ``train`` or ``val``.

    A window trains a fold if its targets end before the fold's validation weeks, and validates it
    if its targets are exactly those weeks. Other combinations vanish.
    """
    every = F.struct("fold", "train_end", "val_start", "val_end")
    bounds = fold_bounds(weekly, folds, step, horizon).agg(F.array_sort(F.collect_list(every))).scalar()
    out = samples.withColumn("_b", F.explode(bounds))
    b = F.col("_b")
    split = F.when(F.col("tgt_end") <= b["train_end"], "train").when(
        (F.col("tgt_start") == b["val_start"]) & (F.col("tgt_end") == b["val_end"]), "val")
    return out.withColumn("fold", b["fold"]).withColumn("split", split).drop("_b").filter(F.col("split").isNotNull())


def fold_training_scores(
    weekly: DataFrame, fold_samples: DataFrame, window: int = WINDOW, horizon: int = HORIZON,
) -> DataFrame:
    """Scores a fold may learn from: rows up to the last target of its last training window.

    Expects ``pos`` in ``weekly``. Every region has one row per fold in ``reach``, attached so that a
    long region is divided among tasks.
    """
    reach = (
        fold_samples.filter(F.col("split") == "train").groupBy(KEY, "fold")
        .agg((F.max("start") + window + horizon).alias("_until"))
    )
    rows = weekly.filter(F.col("score").isNotNull()).select(KEY, "pos", "score")
    return (
        attach(rows, reach, "pos", how="inner").filter(F.col("pos") < F.col("_until"))
        .select("fold", KEY, "pos", "score")
    )
