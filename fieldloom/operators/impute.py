"""Filling of missing values along time, and null profiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import MEASURES, ZERO_FILLED
from .splits import CHUNK, KEY, attach, chunk_window, day_rows, spread, trim, week_rows


def present(cols: list[str], df: DataFrame) -> list[str]:
    return [c for c in cols if c in df.columns]


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row table as the struct ``_one``: a single scalar subquery."""
    return df.withColumn("_one", one_row.select(F.struct("*")).scalar())


def fill_along(df: DataFrame, cols: list[str], pos: str, rows: int, backward: bool) -> DataFrame:
    """Unlimited forward fill, then backward fill if asked for, per region.

    Rows are filled inside their chunk. What an earlier chunk hands over is its last value, found
    in one small table with a row per region and chunk. A row that is still missing then has no
    value before it, so backward fill takes the first value of its chunk, else of a later one.
    """
    df = spread(df, pos, rows)
    known = {c: F.when(F.col(c).isNotNull(), F.col(pos)) for c in cols}
    edges = df.groupBy(KEY, CHUNK).agg(
        *[F.max_by(c, known[c]).alias(f"_l_{c}") for c in cols],
        *([F.min_by(c, known[c]).alias(f"_f_{c}") for c in cols] if backward else []),
    )
    by_chunk = Window.partitionBy(KEY).orderBy(CHUNK)
    past = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    # The next value seen from here, by running over the chunks from the last to the first.
    onward = Window.partitionBy(KEY).orderBy(F.desc(CHUNK)).rowsBetween(Window.unboundedPreceding, 0)
    handed = edges.select(
        KEY, CHUNK,
        *[F.last(f"_l_{c}", True).over(past).alias(f"_l_{c}") for c in cols],
        *([F.last(f"_f_{c}", True).over(onward).alias(f"_f_{c}") for c in cols] if backward else []),
    )
    up_to = chunk_window(pos).rowsBetween(Window.unboundedPreceding, 0)

    def filled(c: str):
        steps = [F.last(c, True).over(up_to), F.col(f"_l_{c}")] + ([F.col(f"_f_{c}")] if backward else [])
        return F.coalesce(*steps).alias(c)

    return df.join(handed, [KEY, CHUNK]).select(
        *[filled(c) if c in cols else F.col(c) for c in df.columns if c != CHUNK]
    )


def fill_both_ways(daily: DataFrame, whole: bool = False) -> DataFrame:
    """Forward, then backward fill of every measure. ``whole``: regions are short and each is filled at once."""
    if whole:
        by_pos = Window.partitionBy(KEY).orderBy("pos").rowsBetween
        so_far, all_of_it = (by_pos(Window.unboundedPreceding, end) for end in (0, Window.unboundedFollowing))
        return daily.select(*[
            F.coalesce(F.last(c, True).over(so_far), F.first(c, True).over(all_of_it)).alias(c) if c in MEASURES else F.col(c)
            for c in daily.columns])
    return fill_along(daily, present(MEASURES, daily), "pos", day_rows(), backward=True)


def fill_or_zero(weekly: DataFrame, cols: list[str]) -> DataFrame:
    """Forward fill, then 0: how gaps in test features are closed."""
    cols = present(cols, weekly)
    return fill_along(weekly, cols, "week_idx", week_rows(), backward=False).fillna(0, subset=cols)


def fill_limited(daily: DataFrame, cols: list[str], limit: int = 3) -> DataFrame:
    """Forward fill over at most ``limit`` rows."""
    rows = day_rows()
    frame = chunk_window("pos").rowsBetween(-limit, 0)
    out = spread(daily, "pos", rows, back=limit)
    out = out.select(*[
        F.last(c, True).over(frame).alias(c) if c in cols else F.col(c) for c in out.columns
    ])
    return trim(out, "pos", rows)


def fill_region_mean(daily: DataFrame, cols: list[str], means: DataFrame | None = None) -> DataFrame:
    """Replace what is still missing by the region's mean of ``daily`` as given (or from ``means``)."""
    means = daily.groupBy(KEY).agg(*[F.avg(c).alias(c) for c in cols]) if means is None else means
    out = attach(daily, means.select(KEY, *[F.col(c).alias(f"_m_{c}") for c in cols]), "pos")
    return out.select(*[
        F.coalesce(c, f"_m_{c}").alias(c) if c in cols else F.col(c) for c in daily.columns
    ])


def fill_global_mean(daily: DataFrame, cols: list[str], source: DataFrame | None = None) -> DataFrame:
    """Replace what is still missing by the overall mean (of ``source`` if given)."""
    means = (daily if source is None else source).agg(*[F.avg(c).alias(c) for c in cols])
    return with_row(daily, means).select(*[
        F.coalesce(F.col(c), F.col(f"_one.{c}")).alias(c) if c in cols else F.col(c) for c in daily.columns
    ])


def fill_zero(df: DataFrame, cols: list[str] = ZERO_FILLED) -> DataFrame:
    return df.fillna(0.0, subset=present(cols, df))


def fill_climate(daily: DataFrame, staged=lambda df: df, kept=lambda df: df) -> DataFrame:
    """Zero for rain and pressure; otherwise three-day fill, region mean, overall mean.

    ``staged`` is applied to the three-day fill, which both means and the result read, ``kept`` to
    the table of region means, from which the overall means follow.
    """
    cols = [c for c in present(MEASURES, daily) if c not in ZERO_FILLED]
    short = staged(fill_limited(fill_zero(daily), cols))
    per_region = kept(short.groupBy(KEY).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in cols]))
    filled = fill_region_mean(short, cols, per_region)
    return with_row(filled, overall_means(per_region, cols)).select(*[
        F.coalesce(F.col(c), F.col(f"_one.{c}")).alias(c) if c in cols else F.col(c) for c in filled.columns
    ])


def last_known(runs: DataFrame, cols: list[str]) -> DataFrame:
    """Runs of days (see ``sources.panel``), a bounded number per region, with the last value so far, ``_k_<c>``, and its ``pos``, ``_at_<c>``."""
    so_far = Window.partitionBy(KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("pos"))
    return runs.withColumns({
        **{f"_k_{c}": F.last(c, True).over(so_far) for c in cols}, **{f"_at_{c}": F.last(at(c), True).over(so_far) for c in cols}})


def held_value(c: str, off: Column, limit: int = 3) -> Column:
    """``fill_limited`` on the day ``off`` days after the first one of its run."""
    return F.when(F.col("pos") + off - F.col(f"_at_{c}") <= limit, F.col(f"_k_{c}"))


def held_means(runs: DataFrame, cols: list[str], limit: int = 3) -> DataFrame:
    """Mean per region of the days that ``held_value`` gives, and the region's number of days, from the runs."""
    length = F.col("until") - F.col("day_idx")

    def mean(c: str) -> Column:
        days = F.when(F.col(f"_k_{c}").isNotNull(), F.greatest(
            F.lit(0), F.least(length, F.col(f"_at_{c}") + limit + 1 - F.col("pos"))))
        total = F.sum(days)
        return F.when(total > 0, F.sum(F.col(f"_k_{c}") * days) / total).alias(c)

    return runs.groupBy(KEY).agg(F.sum(length).alias("_n"), *[mean(c) for c in cols])


def overall_means(per_region: DataFrame, cols: list[str]) -> DataFrame:
    """That of the region-filled values: every region adds its mean once per missing row, so sums and counts
    per region give it without filling the rows first."""
    return per_region.agg(*[
        (F.sum(F.col(c) * F.col("_n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("_n")))).alias(c)
        for c in cols])


def drop_incomplete(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.dropna(subset=present(cols, df))


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing values per column, one pass."""
    cols = present(cols, df)
    one = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return one.unpivot([], cols, "column", "nulls")
