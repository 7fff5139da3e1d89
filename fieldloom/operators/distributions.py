"""Percentiles, shares, histograms, densities and box statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import PERCENTS, SHARE_BINS
from ..functions.scalars import in_bin
from .ranks import cumulative_counts, place, placed_quantiles, quantiles


def submission_values(wide: DataFrame, model: str) -> DataFrame:
    """All columns but the first, as one column of values labelled ``model``."""
    cols = wide.columns[1:]
    return wide.unpivot([], cols, "_week", "value").select(F.lit(model).alias("grp"), F.col("value").cast("double"))


def percentile_table(long: DataFrame, percents: list[int] = PERCENTS) -> DataFrame:
    """One row per group, one column per percentage."""
    q = quantiles(long, [p / 100 for p in percents])
    return q.groupBy("grp").agg(*[
        F.max(F.when(F.abs(F.col("prob") - p / 100) < 1e-9, F.col("quantile"))).alias(f"p{p}") for p in percents])


def share_name(label: str) -> str:
    return "share_" + label.replace("-", "_to_").replace(".", "_")


def share_table(long: DataFrame) -> DataFrame:
    """Share of values per interval; values outside all intervals count in the denominator only."""
    return long.groupBy("grp").agg(*[
        F.avg(F.coalesce(in_bin(F.col("value"), low, high), F.lit(False)).cast("double")).alias(share_name(name))
        for name, low, high in SHARE_BINS])


def density(
    long: DataFrame, points: int = 200, low: float | None = None, high: float | None = None,
    factor: float | None = None, scott: float = 0.5,
) -> DataFrame:
    """Gaussian kernel density (grp, x, density) on an even grid.

    Bandwidth is ``factor`` times the sample sd or, without one, ``scott`` times Scott's rule. The
    grid spans [low, high], by default the data range widened by half of it on either side. Each task
    adds up the kernels of its values on the whole grid and hands on one row per group and point.
    """
    half = (F.max("value") - F.min("value")) / 2.0
    sd = F.stddev_samp("value")
    width = sd * (F.lit(factor) if factor is not None else scott * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2)))
    # One row per group; groups are columns or models.
    stats = {r["grp"]: r for r in long.groupBy("grp").agg(
        F.count(F.lit(1)).cast("double").alias("n"), width.alias("h"),
        (F.lit(float(low)) if low is not None else F.min("value") - half).alias("lo"),
        (F.lit(float(high)) if high is not None else F.max("value") + half).alias("hi")).collect()}
    grids = {g: r["lo"] + np.arange(points) * (r["hi"] - r["lo"]) / (points - 1) for g, r in stats.items()}
    widths = {g: r["h"] or float("nan") for g, r in stats.items()}

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for batch in batches:
            for g, values in batch.groupby("grp")["value"]:
                v, grid = values.to_numpy(), grids[g]
                for at in range(0, len(v), 1024):
                    u = (grid - v[at:at + 1024, None]) / widths[g]
                    total[g] = total.get(g, 0.0) + np.exp(-0.5 * u * u).sum(0)
        for g, sums in total.items():
            yield pd.DataFrame({"grp": g, "j": np.arange(points), "part": sums})

    parts = long.select("grp", "value").mapInPandas(kernels, "grp string, j int, part double")
    scale = long.sparkSession.createDataFrame(
        [(g, float(r["lo"]), float(r["hi"]), r["h"] and r["n"] * r["h"] * math.sqrt(2 * math.pi)) for g, r in stats.items()],
        "grp string, lo double, hi double, scale double")
    x = F.col("lo") + F.col("j") * (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    sums = parts.groupBy("grp", "j").agg(F.sum("part").alias("part"))
    return sums.join(F.broadcast(scale), "grp").select("grp", "j", x.alias("x"), (F.col("part") / F.col("scale")).alias("density"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, count) of even bins over the data range; the last bin is closed. Empty bins keep a row."""
    v = F.col(value)
    flat = F.max(value) == F.min(value)
    span = df.select(F.struct(
        F.when(flat, F.min(value) - 0.5).otherwise(F.min(value)).cast("double").alias("lo"),
        F.when(flat, F.max(value) + 0.5).otherwise(F.max(value)).cast("double").alias("hi"))).scalar()
    at = F.least(F.floor((v - span["lo"]) / (span["hi"] - span["lo"]) * bins), F.lit(bins - 1))
    return _all_bins(df.filter(v.isNotNull()).select(at.cast("int").alias("bin")), bins)


def _all_bins(placed: DataFrame, bins: int) -> DataFrame:
    """Counts of ``bin`` 0..bins-1 with zeros for the bins nobody falls into."""
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    every = placed.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").fillna(0, subset=["count"])


def edge_histogram(df: DataFrame, value: str, low: float, step: float, bins: int) -> DataFrame:
    """Counts in ``bins`` fixed bins from ``low``; values beyond the edges are left out."""
    v = F.col(value)
    high = low + step * bins
    at = F.least(F.floor((v - low) / step), F.lit(bins - 1)).cast("int")
    return _all_bins(df.filter((v >= low) & (v <= high)).select(at.alias("bin")), bins).withColumn(
        "left", low + step * F.col("bin"))


def around_integers(df: DataFrame, value: str, top: int = 5) -> DataFrame:
    """Counts within a quarter of each integer, lower edge closed, and their share."""
    v = F.col(value)
    hits = [F.count(F.when((v >= i - 0.25) & (v < i + 0.25), 1)).alias(f"n{i}") for i in range(top + 1)]
    rows = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"n{i}").alias("count"),
                              F.try_divide(F.col(f"n{i}"), F.col("n")).alias("share")) for i in range(top + 1)])
    return df.agg(F.count(value).alias("n"), *hits).select(F.inline(rows))


def empirical_cdf(long: DataFrame) -> DataFrame:
    """(grp, value, cdf) for every distinct value."""
    c = cumulative_counts(long)
    return c.select("grp", "value", ((F.col("before") + F.col("cnt")) / F.col("total")).alias("cdf"))


def box_stats(long: DataFrame) -> DataFrame:
    """Quartiles, whiskers (the outermost points within 1.5 IQR) and outlier counts per group."""
    placed = place(long)
    q = placed_quantiles(placed, [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("quantile")))
    # One row per group; groups are columns or clusters.
    box = q.groupBy("grp").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    v, iqr = F.col("value"), F.col("q3") - F.col("q1")
    inside = (v >= F.col("q1") - 1.5 * iqr) & (v <= F.col("q3") + 1.5 * iqr)
    return placed.rows.join(F.broadcast(box), "grp").groupBy("grp", "q1", "median", "q3").agg(
        F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("outliers"), F.count(F.lit(1)).alias("n"))
