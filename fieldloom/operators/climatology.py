"""Padding of short histories from a day-of-year climatology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import MEASURES, PAD_WEEKS_V51
from ..functions.calendar import LEAP_SLOT, ordinal, slot_of_ordinal, subtract_days, year_of_ordinal
from .impute import present, with_row
from .splits import KEY


def _ordinal(daily: DataFrame) -> Column:
    """The day number that an indexed panel carries, else from the date."""
    return F.col("ordinal") if "ordinal" in daily.columns else ordinal("date")


def leap_phases(daily: DataFrame) -> DataFrame:
    """Year mod 4 of each region's first February 29."""
    day = _ordinal(daily)
    return (
        daily.filter(slot_of_ordinal(day) == LEAP_SLOT)
        .groupBy(KEY).agg(F.min(day).alias("day")).select(KEY, F.pmod(year_of_ordinal(F.col("day")), F.lit(4)).cast("int").alias("phase"))
    )


def climatology(daily: DataFrame) -> DataFrame:
    """Mean of every measure per region and slot of the year."""
    cols = present(MEASURES, daily)
    return daily.groupBy(KEY, slot_of_ordinal(_ordinal(daily)).alias("doy")).agg(*[F.avg(c).alias(c) for c in cols])


def global_means(daily: DataFrame) -> DataFrame:
    return daily.agg(*[F.avg(c).alias(c) for c in present(MEASURES, daily)])


def pad_days(test: DataFrame, phases: DataFrame, days: int) -> DataFrame:
    """The ``days`` dates before each region's first one; ``pos`` 0 is the earliest."""
    first = test.groupBy(KEY).agg(F.min_by("date", _ordinal(test)).alias("first"))
    return (
        first.join(phases, KEY, "left")
        .withColumn("back", F.explode(F.sequence(F.lit(1), F.lit(days))))
        .select(KEY, subtract_days("first", F.col("back"), F.col("phase")).alias("date"),
                (F.lit(days) - F.col("back")).cast("long").alias("pos"))
        .withColumn("ordinal", ordinal("date"))
    )


def fill_pad(pad: DataFrame, baseline: DataFrame, overall: DataFrame) -> DataFrame:
    """Look the padded days up in the climatology; days it lacks get the overall mean."""
    cols = present(MEASURES, baseline)
    looked_up = pad.withColumn("doy", slot_of_ordinal(_ordinal(pad))).join(baseline, [KEY, "doy"], "left")
    return with_row(looked_up, overall.select(*cols)).select(
        *pad.columns, *[F.coalesce(F.col(c), F.col(f"_one.{c}")).alias(c) for c in cols])


def prepend(pad: DataFrame, test: DataFrame, days: int) -> DataFrame:
    shifted = test.withColumn("pos", F.col("pos") + days)
    return pad.unionByName(shifted, allowMissingColumns=True)


def pad_slots(pad: DataFrame) -> DataFrame:
    """The slots of the year that the padding of a region looks up, as the array ``_slots``."""
    return pad.groupBy(KEY).agg(F.collect_set(slot_of_ordinal(_ordinal(pad))).alias("_slots"))


def pad_from_climatology(
    train: DataFrame, test: DataFrame, weeks: int = PAD_WEEKS_V51, overall: DataFrame | None = None,
) -> DataFrame:
    """``test`` with ``weeks`` whole weeks in front, drawn from the climatology of ``train``."""
    pad = pad_days(test, leap_phases(train), weeks * 7)
    means = global_means(train) if overall is None else overall
    return prepend(fill_pad(pad, climatology(train), means), test, weeks * 7)
