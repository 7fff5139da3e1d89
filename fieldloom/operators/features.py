"""Weekly features: trailing frames, lags, water balance and anomalies.

Statistics learnt from the train cohort are a DataFrame that is passed on, never kept globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import LAGGED
from ..functions.scalars import aridity, at_least, pet
from .impute import fill_or_zero, present
from .splits import KEY, attach, chunk_window, weekly_frames

INDEX_V51 = ["pet", "deficit", "deficit_roll_cum_4w", "aridity_index", "heat_shock", "tmp_anomaly"]
INDEX_V54 = [
    "pet", "water_shortage", "water_shortage_roll_cum_4w", "water_shortage_roll_cum_8w",
    "cross_shortage_x_anomaly", "is_dry_spell", "shortage_momentum", "aridity_index", "heat_shock",
    "tmp_anomaly",
]


def trailing(weeks: int):
    return chunk_window("week_idx").rowsBetween(-(weeks - 1), 0)


@weekly_frames(back=3)
def rolling(weekly: DataFrame) -> DataFrame:
    frame = trailing(4)
    new = {"prec_roll_sum_4w": F.sum("prec").over(frame)} if "prec" in weekly.columns else {}
    for c in present(["tmp", "humidity"], weekly):
        new[f"{c}_roll_mean_4w"] = F.avg(c).over(frame)
    return weekly.withColumns(new)


@weekly_frames(back=2)
def lags(weekly: DataFrame, cols: list[str] = LAGGED) -> DataFrame:
    w = chunk_window("week_idx")
    return weekly.withColumns({
        f"{c}_lag{k}w": F.lag(c, k).over(w) for c in present(cols, weekly) for k in (1, 2)
    })


def water_balance(weekly: DataFrame) -> DataFrame:
    """``pet`` and the signed ``deficit``."""
    return weekly.withColumn("pet", pet(F.col("tmp"))).withColumn("deficit", F.col("prec") - F.col("pet"))


def shortage(weekly: DataFrame) -> DataFrame:
    """``pet`` and how far rain falls short of it."""
    return weekly.withColumn("pet", pet(F.col("tmp"))).withColumn(
        "water_shortage", at_least(F.col("pet") - F.col("prec"), F.lit(0.0)))


def heat(weekly: DataFrame) -> DataFrame:
    new = {"aridity_index": aridity(F.col("tmp"), F.col("humidity"))}
    if "tmp_week_max" in weekly.columns:
        new["heat_shock"] = F.col("tmp_week_max") - F.col("tmp")
    return weekly.withColumns(new)


@weekly_frames(back=3)
def deficit_sums(weekly: DataFrame) -> DataFrame:
    return weekly.withColumn("deficit_roll_cum_4w", F.sum("deficit").over(trailing(4)))


@weekly_frames(back=7)
def shortage_sums(weekly: DataFrame) -> DataFrame:
    return weekly.withColumns({
        f"water_shortage_roll_cum_{k}w": F.sum("water_shortage").over(trailing(k)) for k in (4, 8)
    })


@weekly_frames(back=1)
def dry_spell(weekly: DataFrame) -> DataFrame:
    wettest = F.max("prec").over(trailing(2))
    return weekly.withColumn("is_dry_spell", F.coalesce(wettest < 0.5, F.lit(False)).cast("byte"))


@weekly_frames(back=2)
def momentum(weekly: DataFrame) -> DataFrame:
    w = chunk_window("week_idx")
    earlier = [F.coalesce(F.lag("water_shortage", k).over(w), F.lit(0.0)) for k in (1, 2)]
    total = 4.0 * F.col("water_shortage") + 2.0 * earlier[0] + earlier[1]
    return weekly.withColumn("shortage_momentum", total * total)


def fit_anomaly(train: DataFrame) -> DataFrame:
    """Mean and sample sd of weekly temperature per region; a constant region gets sd 1."""
    sd = F.stddev_samp("tmp")
    return train.groupBy(KEY).agg(
        F.avg("tmp").alias("tmp_mu"), F.when(sd == 0, F.lit(1.0)).otherwise(sd).alias("tmp_sd"))


def fit_anomaly_for_test(test: DataFrame, train_stats: DataFrame) -> DataFrame:
    """Train statistics for the regions of ``test``; unseen ones get their own mean and sd 1."""
    own = test.groupBy(KEY).agg(F.avg("tmp").alias("_own"))
    known = train_stats.withColumn("_known", F.lit(True))
    unseen = F.col("_known").isNull()
    return own.join(known, KEY, "left").select(
        KEY,
        F.when(unseen, F.col("_own")).otherwise(F.col("tmp_mu")).alias("tmp_mu"),
        F.when(unseen, F.lit(1.0)).otherwise(F.col("tmp_sd")).alias("tmp_sd"))


def anomaly(weekly: DataFrame, stats: DataFrame) -> DataFrame:
    out = attach(weekly, stats, "week_idx")
    z = (F.col("tmp") - F.col("tmp_mu")) / F.col("tmp_sd")
    return out.withColumn("tmp_anomaly", z).drop("tmp_mu", "tmp_sd")


@weekly_frames(back=3)
def index_frames_v51(weekly: DataFrame) -> DataFrame:
    """Everything of the first index set that needs neighbouring weeks but no statistics."""
    return heat(deficit_sums(water_balance(weekly)))


@weekly_frames(back=7)
def index_frames_v54(weekly: DataFrame) -> DataFrame:
    """Everything of the second index set that needs neighbouring weeks but no statistics."""
    return heat(momentum(dry_spell(shortage_sums(shortage(weekly)))))


def finish_index(weekly: DataFrame, stats: DataFrame, is_train: bool, variant: str) -> DataFrame:
    """Anomaly and what derives from it. Gaps of the test cohort are closed."""
    fitted = stats if is_train else fit_anomaly_for_test(weekly, stats)
    out = anomaly(weekly, fitted)
    if variant == "v54":
        warm = at_least(F.col("tmp_anomaly"), F.lit(0.0))
        out = out.withColumn("cross_shortage_x_anomaly", F.col("water_shortage_roll_cum_4w") * warm)
    if is_train:
        return out
    return fill_or_zero(out, INDEX_V54 if variant == "v54" else INDEX_V51)


def index_v51(weekly: DataFrame, stats: DataFrame, is_train: bool) -> DataFrame:
    return finish_index(index_frames_v51(weekly), stats, is_train, "v51")


def index_v54(weekly: DataFrame, stats: DataFrame, is_train: bool) -> DataFrame:
    return finish_index(index_frames_v54(weekly), stats, is_train, "v54")


def cohort_counts(train: DataFrame, test: DataFrame, regions: int, train_rows: int, test_rows: int) -> DataFrame:
    """Regions of each cohort against the expected number, spread of their sizes, and how many are off."""
    parts = []
    for name, df, rows in (("train", train, train_rows), ("test", test, test_rows)):
        per = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per.agg(
            F.count(F.lit(1)).alias("regions"), F.min("n").alias("rows_min"), F.max("n").alias("rows_max"),
            F.count(F.when(F.col("n") != rows, 1)).alias("violations")).select(
            F.lit(name).alias("cohort"), "regions", F.lit(regions).cast("long").alias("expected"), "rows_min", "rows_max", "violations"))
    return parts[0].unionByName(parts[1])


def size_violations(df: DataFrame, expected: int) -> DataFrame:
    """Regions whose number of rows differs from ``expected``; empty when the panel is sound."""
    return df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected)
