"""Days to weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import WEEKLY_MEANS, WEEKLY_SPREADS, WEEKLY_SUMS
from ..functions.calendar import date_of_ordinal, ordinal, slot_of_ordinal, week_angle, week_angle_of, year_width
from .splits import CHUNK, KEY


def week_index(daily: DataFrame) -> DataFrame:
    """Positional week: seven rows of the region, wherever they lie in the calendar."""
    return daily.withColumn("week_idx", F.floor(F.col("pos") / 7))


def roll_up_pieces(pieces: DataFrame) -> DataFrame:
    """``roll_up`` of rows that stand for ``days`` equal days of their week ``week_idx``.

    ``ordinal`` is that of the last of these days, ``score`` the largest; years are written without zeros in front.
    """
    has, n = set(pieces.columns), F.col("days")
    total = lambda c: F.sum(F.col(c) * n)
    count = lambda c: F.sum(F.when(F.col(c).isNotNull(), n))
    mean = lambda c: (total(c) / count(c)).alias(c)
    aggs = []
    for c in (c for c in WEEKLY_SUMS if c in has):
        aggs += [F.coalesce(total(c), F.lit(0.0)).alias(c), F.max(c).alias(f"{c}_week_max")]
    for c in (c for c in WEEKLY_SPREADS if c in has):
        squares = F.sum(F.col(c) * F.col(c) * n) - total(c) * total(c) / count(c)
        # Equal days have none, whatever the last bit of the sums.
        sd = F.when((F.max(c) > F.min(c)) & (squares > 0), F.sqrt(squares / (count(c) - 1))).otherwise(0.0)
        aggs += [mean(c), F.max(c).alias(f"{c}_week_max"), F.min(c).alias(f"{c}_week_min"), sd.alias(f"{c}_week_std")]
    aggs += [mean(c) for c in WEEKLY_MEANS if c in has]
    if "score" in has:
        aggs.append(F.max("score").alias("score"))
    weekly = pieces.groupBy(KEY, "week_idx").agg(*aggs, F.max("ordinal").alias("day_ordinal"))
    angle = week_angle_of(slot_of_ordinal(F.col("day_ordinal")))
    return weekly.withColumns({
        "week_end_date": date_of_ordinal(F.col("day_ordinal")), "week_sin": F.sin(angle), "week_cos": F.cos(angle)})


def roll_up(daily: DataFrame) -> DataFrame:
    """One row per region and positional week.

    On a spread frame the chunk stays part of the key: weeks never straddle chunks, so the rows
    are aggregated where they already are.
    """
    has = set(daily.columns)
    aggs = []
    for c in (c for c in WEEKLY_SUMS if c in has):
        aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(c), F.max(c).alias(f"{c}_week_max")]
    for c in (c for c in WEEKLY_SPREADS if c in has):
        aggs += [
            F.avg(c).alias(c), F.max(c).alias(f"{c}_week_max"), F.min(c).alias(f"{c}_week_min"),
            F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_week_std"),
        ]
    aggs += [F.avg(c).alias(c) for c in WEEKLY_MEANS if c in has]
    if "score" in has:
        aggs.append(F.max("score").alias("score"))
    # The last day as a number: with fixed-width buffers only, Spark aggregates by hash, unsorted.
    # Its low four bits are the width of the year, so that the date comes back as it was written.
    day = F.col("ordinal") if "ordinal" in has else ordinal("date")
    aggs.append(F.max(day * 16 + year_width("date")).alias("_last"))
    keys = [KEY] + ([CHUNK] if CHUNK in has else []) + ["week_idx"]
    weekly = week_index(daily).groupBy(*keys).agg(*aggs).withColumn("day_ordinal", F.floor(F.col("_last") / 16))
    angle = week_angle("week_end_date")
    return weekly.withColumn("week_end_date", date_of_ordinal(
        F.col("day_ordinal"), (F.col("_last") % 16).cast("int"))).withColumns(
        {"week_sin": F.sin(angle), "week_cos": F.cos(angle)}).drop("_last")
