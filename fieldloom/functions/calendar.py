"""Column expressions for the 366-slot calendar.

Dates are strings ``y-mm-dd``. The year need not be padded and February 29 may occur in any year,
so they never become a Spark date; only month borrowing uses one, in a year of the same leap phase.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import DEFAULT_LEAP_PHASE, MONTH_LENGTHS, MONTH_OFFSETS, SLOTS_PER_YEAR


def _part(date, i: int) -> Column:
    return F.split_part(F.col(date) if isinstance(date, str) else date, F.lit("-"), F.lit(i)).cast("int")


def year_of(date) -> Column:
    return _part(date, 1)


def month_of(date) -> Column:
    return _part(date, 2)


def day_of(date) -> Column:
    return _part(date, 3)


def year_slot(date) -> Column:
    """Slot 1..366 within the year; March 1 is always 61."""
    offsets = F.array(*[F.lit(o) for o in MONTH_OFFSETS])
    return F.element_at(offsets, month_of(date)) + day_of(date)


def ordinal(date) -> Column:
    """Sortable day number. Common years leave a hole at February 29."""
    return ((year_of(date).cast("long") - 1) * SLOTS_PER_YEAR) + year_slot(date) - 1


def ordinal_of(year: Column, month: Column, day: Column) -> Column:
    """The same from the parts of a date."""
    return (year - 1) * SLOTS_PER_YEAR + F.element_at(F.array(*[F.lit(o) for o in MONTH_OFFSETS]), month) + day - 1


#: The slot of February 29.
LEAP_SLOT = 60


def slot_of_ordinal(n: Column) -> Column:
    return (n % SLOTS_PER_YEAR + 1).cast("int")


def year_of_ordinal(n: Column) -> Column:
    return F.floor(n / SLOTS_PER_YEAR) + 1


def year_width(date) -> Column:
    """Characters of the year as it is written."""
    text = F.col(date) if isinstance(date, str) else date
    dash = F.instr(text, "-")
    return F.when(dash > 0, dash - 1).otherwise(F.length(text))


def date_of_ordinal(n: Column, width: Column | None = None) -> Column:
    """The date string with ordinal ``n``; the year is filled up with zeros to ``width``."""
    slot = slot_of_ordinal(n)
    offsets = F.array(*[F.lit(o) for o in MONTH_OFFSETS])
    month = sum(((slot > o).cast("int") for o in MONTH_OFFSETS), F.lit(0))
    year = (F.floor(n / SLOTS_PER_YEAR) + 1).cast("string")
    if width is not None:
        year = F.lpad(year, F.greatest(width, F.length(year)), F.lit("0"))
    return format_date(year, month, slot - F.element_at(offsets, month))


def days_in_month(year: Column, month: Column, phase: Column) -> Column:
    lengths = F.array(*[F.lit(n) for n in MONTH_LENGTHS])
    leap = F.pmod(year, F.lit(4)) == F.coalesce(phase, F.lit(DEFAULT_LEAP_PHASE))
    return F.when((month == 2) & leap, F.lit(29)).otherwise(F.element_at(lengths, month))


def format_date(year: Column, month: Column, day: Column) -> Column:
    two = lambda c: F.concat(F.when(c < 10, "0").otherwise(""), c.cast("string"))
    return F.concat(year.cast("string"), F.lit("-"), two(month), F.lit("-"), two(day))


def subtract_days(date, days: Column, phase: Column) -> Column:
    """``date`` minus ``days`` where February has 29 days iff year mod 4 equals ``phase``.

    The year is mapped to 2004..2007 with the same leap phase, moved there and mapped back; exact
    for moves of up to a century.
    """
    y, m, d = year_of(date), month_of(date), day_of(date)
    twin = F.lit(2004) + F.pmod(y - F.coalesce(phase, F.lit(DEFAULT_LEAP_PHASE)), F.lit(4))
    moved = F.date_add(F.make_date(twin, m, F.lit(1)), (d - 1 - days).cast("int"))
    return format_date(y + F.year(moved) - twin, F.month(moved), F.dayofmonth(moved))


def week_angle(date) -> Column:
    return week_angle_of(year_slot(date))


def week_angle_of(slot: Column) -> Column:
    return F.lit(2.0) * F.pi() * slot / F.lit(365.25)
