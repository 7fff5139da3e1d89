"""Small column expressions shared by the operators. Missing values stay NULL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nan_to_null(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c)).alias(c)


def at_least(c: Column, low: float | Column) -> Column:
    """Lower clip. ``greatest`` would turn NULL into the bound."""
    return F.when(c < low, low).otherwise(c)


def within(c: Column, low: float | Column, high: float | Column) -> Column:
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def log_rain(c: Column) -> Column:
    return F.log1p(at_least(c, F.lit(0.0)))


def bounded_score(c: Column) -> Column:
    return within(c, F.lit(0.0), F.lit(5.0))


def in_bin(c: Column, low: float | None, high: float | None) -> Column:
    """``low < c <= high``; the bin without a lower edge is the exact value ``high``."""
    if low is None:
        return c == F.lit(high)
    return (c > F.lit(low)) if high is None else (c > F.lit(low)) & (c <= F.lit(high))


def pet(tmp: Column) -> Column:
    """Evaporation proxy from temperature."""
    return F.lit(0.55) * at_least(tmp, F.lit(0.0))


def vapour_deficit(tmp: Column, humidity: Column) -> Column:
    return tmp * (F.lit(100.0) - humidity) / F.lit(100.0)


def aridity(tmp: Column, humidity: Column) -> Column:
    return F.try_divide(tmp, humidity + F.lit(1.0))
