"""Clipping, scaling and row filters."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import CLIPPED, KEEP_DAYS, LOGGED, UNUSED_BY_MODEL, Z_LIMIT
from ..functions.scalars import at_least, log_rain, within
from .impute import present, with_row


def outlier_stats(df: DataFrame, cols: list[str] = CLIPPED) -> DataFrame:
    """Mean and sample sd of every clipped column, in one row."""
    cols = present(cols, df)
    return df.agg(*[F.avg(c).alias(f"{c}_mu") for c in cols], *[F.stddev_samp(c).alias(f"{c}_sd") for c in cols])


def _total(pairs: list[tuple[Column, Column]], of) -> Column:
    return F.sum(functools.reduce(operator.add, [F.when((n > 0) & v.isNotNull(), of(v) * n).otherwise(0.0) for v, n in pairs]))


def _days(pairs: list[tuple[Column, Column]]) -> Column:
    return _total(pairs, lambda v: F.lit(1.0))


def means_of_parts(df: DataFrame, parts: dict[str, list[tuple[Column, Column]]]) -> DataFrame:
    """Means over days, in one row, where a row stands for many equal days (see ``outlier_stats_of_parts``)."""
    return df.agg(*[F.try_divide(_total(p, lambda v: v), _days(p)).alias(c) for c, p in parts.items()])


def outlier_stats_of_parts(df: DataFrame, parts: dict[str, list[tuple[Column, Column]]], staged=lambda df: df) -> DataFrame:
    """``outlier_stats`` where a row stands for many equal days: for each column values and how many days have them.

    Deviations are taken from the mean, which is worked out first and given to ``staged``.
    """
    means = staged(means_of_parts(df, parts))

    def sd(c: str) -> Column:
        mu = F.col(f"_one.{c}")
        return F.sqrt(F.try_divide(_total(parts[c], lambda v: (v - mu) * (v - mu)), _days(parts[c]) - 1))

    return with_row(df, means).agg(
        *[F.max(F.col(f"_one.{c}")).alias(f"{c}_mu") for c in parts], *[sd(c).alias(f"{c}_sd") for c in parts])


def clip_outliers(
    df: DataFrame, limit: float = Z_LIMIT, cols: list[str] = CLIPPED, stats: DataFrame | None = None,
    also: dict[str, str] | None = None,
) -> DataFrame:
    """Clip to mean +- limit * sample sd of the frame itself; constant columns stay as they are.

    ``also`` names further columns and the column by whose statistics they are clipped.
    """
    cols = present(cols, df)
    of = {c: c for c in cols} | (also or {})
    table = outlier_stats(df, cols) if stats is None else stats

    def clipped(c: str):
        mu, sd = F.col(f"_one.{of[c]}_mu"), F.col(f"_one.{of[c]}_sd")
        bounded = within(F.col(c), mu - limit * sd, mu + limit * sd)
        return F.when(sd > 0, bounded).otherwise(F.col(c)).alias(c)

    return with_row(df, table).select(*[clipped(c) if c in of else F.col(c) for c in df.columns])


def not_below_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: at_least(F.col(c), F.lit(0.0)) for c in present(cols, df)})


def log_rain_columns(df: DataFrame, cols: list[str] = LOGGED) -> DataFrame:
    return df.withColumns({c: log_rain(F.col(c)) for c in present(cols, df)})


def drop_unused(df: DataFrame, cols: list[str] = UNUSED_BY_MODEL) -> DataFrame:
    return df.drop(*cols)


def keep_first_days(daily: DataFrame, days: int = KEEP_DAYS) -> DataFrame:
    return daily.filter(F.col("pos") < days)


def strip_padding(weekly: DataFrame, weeks: int) -> DataFrame:
    return weekly.filter(F.col("week_idx") >= weeks).withColumn("week_idx", F.col("week_idx") - weeks)
