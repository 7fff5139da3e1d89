import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import calendar as cal
from fieldloom.operators import climatology

LENGTHS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def one(spark, date, expr):
    return spark.createDataFrame([(date,)], "date string").select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("date,slot", [("2021-03-01", 61), ("2021-12-31", 366), ("1-01-01", 1), ("2021-02-29", 60)])
def test_year_slot(spark, date, slot):
    assert one(spark, date, cal.year_slot("date")) == slot


@pytest.mark.parametrize("date,n", [("1-01-01", 0), ("2-01-01", 366)])
def test_ordinal(spark, date, n):
    assert one(spark, date, cal.ordinal("date")) == n


@pytest.mark.parametrize("date,phase,want", [
    ("2022-03-01", 2, "2022-02-29"), ("2021-03-01", None, "2021-02-29"),
    ("2024-03-01", None, "2024-02-28"), ("2021-01-01", None, "2020-12-31"),
])
def test_subtract_one_day(spark, date, phase, want):
    got = one(spark, date, cal.subtract_days("date", F.lit(1), F.lit(phase).cast("int")))
    assert got == want


def test_subtract_days_against_stepping(spark):
    rng = random.Random(7)

    def step_back(y, m, d, phase):
        d -= 1
        if d == 0:
            m -= 1
            if m == 0:
                y, m = y - 1, 12
            d = 29 if m == 2 and y % 4 == phase else LENGTHS[m - 1]
        return y, m, d

    rows = []
    for _ in range(2000):
        y, m, phase, n = rng.randint(1, 2500), rng.randint(1, 12), rng.randint(0, 3), rng.randint(1, 60)
        d = rng.randint(1, LENGTHS[m - 1])
        cur = (y, m, d)
        for _ in range(n):
            cur = step_back(*cur, phase)
        rows.append((f"{y}-{m:02d}-{d:02d}", phase, n, f"{cur[0]}-{cur[1]:02d}-{cur[2]:02d}"))
    df = spark.createDataFrame(rows, "date string, phase int, n int, want string")
    bad = df.filter(cal.subtract_days("date", F.col("n"), F.col("phase")) != F.col("want"))
    assert bad.count() == 0


def test_days_in_month(spark):
    df = spark.createDataFrame([(2021, 2, None), (2022, 2, None), (2022, 2, 2), (2022, 4, 2)], "y int, m int, p int")
    assert [r[0] for r in df.select(cal.days_in_month(F.col("y"), F.col("m"), F.col("p"))).collect()] == [29, 28, 29, 30]


def test_leap_phase_takes_the_first_leap_day(spark):
    df = spark.createDataFrame([(1, "10-02-29"), (1, "9-02-28"), (1, "6-02-29"), (2, "9-03-01")], "region_id long, date string")
    assert [tuple(r) for r in climatology.leap_phases(df).collect()] == [(1, 2)]
