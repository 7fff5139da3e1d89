"""Daily cohorts to model-ready weekly panels, in two variants.

Each daily cohort is shuffled once for imputation and once for everything from roll-up to trailing
features, whose halo is added before the roll-up. Results that several later steps read are written
to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..constants import (
    CLUSTER_FEATURES_V51, CLUSTER_FEATURES_V54, KEEP_DAYS, PAD_WEEKS_V51, PAD_WEEKS_V54,
)
from ..operators import clean, climatology, features, impute, regions, weekly
from ..operators.splits import day_rows, spread, trim, week_rows
from ..session import stage

HALO_WEEKS = 7


@dataclass
class Panels:
    train: DataFrame
    test: DataFrame | None
    region_stats: DataFrame


def weekly_frames(daily: DataFrame, variant: str) -> DataFrame:
    """Roll-up, rolling, lag and index features that need no train statistics: one shuffle."""
    return _frames(weekly.roll_up(spread(daily, "pos", day_rows(), back=HALO_WEEKS * 7)), variant)


def _frames(weeks: DataFrame, variant: str) -> DataFrame:
    out = features.rolling(weeks)
    if variant == "v51":
        out = features.index_frames_v51(features.lags(out))
    else:
        out = features.index_frames_v54(out)
    return trim(out, "week_idx", week_rows())


def as_is(df: DataFrame, label: str) -> DataFrame:
    """In place of ``stage`` where rows are cheaper made again than stored: a panel unfolded from runs that lie by region."""
    return df


def impute_v51(daily: DataFrame, keep=stage) -> DataFrame:
    return keep(impute.fill_both_ways(daily), "filled")


def impute_v54(daily: DataFrame, keep=stage) -> DataFrame:
    return keep(impute.fill_climate(
        daily, lambda df: keep(df, "short-fill"), lambda df: stage(df, "region-means")), "filled")


def clip(daily: DataFrame) -> DataFrame:
    """Clip by the cohort's own statistics, computed once for all readers of the result."""
    return clean.clip_outliers(daily, stats=stage(clean.outlier_stats(daily), "outlier-stats"))


def preprocess(
    train_daily: DataFrame, test_daily: DataFrame, variant: str = "v51", keep_days: int = KEEP_DAYS,
    clusters: bool = True,
) -> Panels:
    """Both indexed daily cohorts (see ``index_panel``) to weekly panels with clusters."""
    if variant not in ("v51", "v54"):
        raise ValueError(f"unknown variant {variant!r}")
    fill = impute_v51 if variant == "v51" else impute_v54
    return weekly_panels(clip(fill(train_daily)), clip(fill(test_daily)), variant, keep_days, clusters)


def weekly_panels(
    train_daily: DataFrame, test_daily: DataFrame | None, variant: str, keep_days: int = KEEP_DAYS,
    clusters: bool = True, keep=stage, rolled: DataFrame | None = None, padded: DataFrame | None = None,
) -> Panels:
    """From cleaned days on. Without a test cohort its panel is None. ``keep`` is applied to the train weeks.

    ``rolled`` are the weeks of the train cohort, ``padded`` the days of the padded test cohort, where these are at hand.
    """
    pad_weeks = PAD_WEEKS_V51 if variant == "v51" else PAD_WEEKS_V54
    frames = weekly_frames(clean.keep_first_days(train_daily, keep_days), variant) if rolled is None else _frames(
        spread(rolled, "week_idx", week_rows(), back=HALO_WEEKS), variant)
    train_w = keep(frames, "train-weeks")
    stats = stage(features.fit_anomaly(train_w), "anomaly-stats")
    train_w = features.finish_index(train_w, stats, True, variant)
    test_w = None
    if test_daily is not None:
        if padded is None:
            overall = stage(climatology.global_means(train_daily), "means")
            padded = climatology.pad_from_climatology(train_daily, test_daily, pad_weeks, overall)
        test_w = stage(weekly_frames(padded, variant), "test-weeks")
        test_w = features.finish_index(test_w, stats, False, variant)

    if variant == "v51":
        per_region, cols = regions.region_stats_v51(train_w), CLUSTER_FEATURES_V51
    else:
        per_region, cols = regions.region_stats_v54(train_w), CLUSTER_FEATURES_V54
    if clusters:
        per_region = stage(regions.cluster_regions(stage(per_region, "region-stats"), cols), "region-clusters")
        train_w = regions.assign_clusters(train_w, per_region, unseen=None)
        test_w = None if test_w is None else regions.assign_clusters(test_w, per_region)
    train_w = clean.log_rain_columns(train_w)
    if test_w is not None:
        test_w = clean.strip_padding(clean.log_rain_columns(test_w), pad_weeks)
    return Panels(train_w, test_w, per_region)
