"""Panel sources: CSV with the declared schema, and a panel derived from order lines."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..constants import MEASURES, RAW_PROFILE_COLUMNS
from ..functions.calendar import format_date, ordinal, ordinal_of
from ..functions.scalars import nan_to_null
from ..operators.splits import dense_position

START = date(1995, 1, 2)
DAYS = 2499
TRAIN_DAYS = 2405
TEST_START = 2408
KEEP_DAYS_HERE = 2401
BLOCK_SLOTS = 366 * 8
#: Lines of a region that a task adds up in about a second.
MOST_LINES = 2_000_000


def panel_schema(with_score: bool = True) -> T.StructType:
    fields = [T.StructField("region_id", T.LongType()), T.StructField("date", T.StringType())]
    fields += [T.StructField(c, T.DoubleType()) for c in MEASURES]
    if with_score:
        fields.append(T.StructField("score", T.DoubleType()))
    return T.StructType(fields)


def read_panel_csv(spark: SparkSession, path: str, region_type: T.DataType | None = None) -> DataFrame:
    """Read a daily panel. The header decides which of the known columns are present."""
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in panel_schema()}
    if region_type is not None:
        known["region_id"] = region_type
    schema = T.StructType([T.StructField(c, known.get(c, T.StringType())) for c in header])
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*[
        nan_to_null(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in schema
    ])


def profile_columns(df: DataFrame, with_score: bool = True) -> DataFrame:
    """Only the columns the raw-data profile needs, as far as they are present."""
    wanted = [c for c in RAW_PROFILE_COLUMNS if c in df.columns and (with_score or c != "score")]
    return df.select(*wanted)


def index_panel(df: DataFrame) -> DataFrame:
    """Add ``ordinal`` and the row position ``pos`` within the region."""
    df = df.withColumn("ordinal", ordinal("date"))
    return dense_position(df, ["ordinal"], F.floor(F.col("ordinal") / BLOCK_SLOTS))


def _any_above(lines: DataFrame, most: int) -> bool:
    """Whether a region has more than ``most`` lines."""
    per_region = lines.groupBy("region_id").agg(F.count(F.lit(1)).alias("n"))
    return bool(per_region.filter(F.col("n") > most).limit(1).count())


def observed_days(
    spark: SparkSession, sf_dir: str, partitions: int | None = None, most_lines: int = MOST_LINES,
) -> DataFrame:
    """Order lines as runs: one row per supplier and day with lines, valid until the next such row.

    ``day_idx`` is the first day of a run, ``until`` the day after its last one, ``pos`` the number of
    days of the region before it; the measures are those of the first day, the rest of a run is
    missing. A run without measures starts the calendar, and one follows each February 29 that a
    region lacks (those ending in 9). About a fifth of the days carry lines, so this is what is
    stored, never the days. ``partitions`` sets into how many they are dealt by region; if a region has more than
    ``most_lines`` lines, they are added up by day before that.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").alias("region_id"), F.datediff(F.col("l_shipdate").cast("date"), F.lit(START)).alias("day_idx"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.lit(False).alias("calendar"))
    leap = [i for i in range(DAYS) if (START + timedelta(i)).strftime("%m-%d") == "02-29"]
    short = F.col("region_id") % 10 == 9
    starts = F.when(short, F.array(*[F.lit(i) for i in [0, *[i + 1 for i in leap]]])).otherwise(F.array(F.lit(0)))
    calendar = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("region_id")).select(
        "region_id", F.explode(starts).alias("day_idx"), F.lit(True).alias("calendar"))
    rows = lines.filter(F.col("day_idx").between(0, DAYS - 1) & ~(short & F.col("day_idx").isin(leap))).unionByName(
        calendar, allowMissingColumns=True)
    # Most days have one line, so sums by day are wider than lines. Lines are moved, once, unless one task would get too many.
    whole = partitions is not None and not _any_above(lines, most_lines)
    seen = (
        (rows.repartition(partitions, "region_id") if whole else rows)
        .groupBy("region_id", "day_idx").agg(
            F.sum(F.col("l_quantity") * F.col("l_discount")).alias("prec"),
            F.sum("l_quantity").alias("surf_pre"),
            (F.avg("l_discount") * 1000.0).alias("humidity"),
            (F.avg("l_extendedprice") / 1000.0 - 20.0).alias("tmp"),
            (F.max("l_extendedprice") / 1000.0 - 20.0).alias("tmp_max"),
            (F.min("l_extendedprice") / 1000.0 - 20.0).alias("tmp_min"),
            (F.avg("l_tax") * 100.0).alias("wind"),
            (F.max("l_tax") * 100.0).alias("wind_max"),
            (F.min("l_tax") * 100.0).alias("wind_min"),
            F.max("calendar").alias("calendar"),
        )
    )
    # At most DAYS rows a region, however many lines it has.
    seen = seen.repartition(partitions, "region_id") if partitions and not whole else seen
    region = Window.partitionBy("region_id")
    nxt = F.coalesce(F.lead("day_idx").over(region.orderBy("day_idx")), F.lit(DAYS))
    runs = seen.withColumn("_known", F.max("calendar").over(region)).withColumn("until", nxt).filter("_known")
    runs = runs.withColumn("until", F.when(short & (F.col("until") - 1).isin(leap), F.col("until") - 1).otherwise(F.col("until")))
    before = F.sum(F.col("until") - F.col("day_idx")).over(region.orderBy("day_idx").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("pos", F.coalesce(before, F.lit(0)).cast("long")).drop("_known", "calendar")


def cut_runs(runs: DataFrame, first: int, end: int) -> DataFrame:
    """The runs of the days from ``first`` up to ``end``, numbered from 0; one that began before has no measures."""
    late = F.greatest(F.lit(first), F.col("day_idx"))
    out = runs.filter((F.col("until") > first) & (F.col("day_idx") < end)).withColumns({
        c: F.when(F.col("day_idx") >= first, F.col(c)) for c in runs.columns if first and c in MEASURES})
    out = out.withColumns({"pos": F.col("pos") + late - F.col("day_idx"), "day_idx": late, "until": F.least(F.lit(end), F.col("until"))})
    if first:
        out = out.withColumn("pos", F.col("pos") - F.min("pos").over(Window.partitionBy("region_id")))
    return out


def derived_measures(df: DataFrame) -> DataFrame:
    hum, tmp = F.col("humidity"), F.col("tmp")
    return df.withColumns({
        "dp_tmp": tmp - (100.0 - hum) / 5.0, "wb_tmp": tmp - (100.0 - hum) / 10.0,
        "tmp_range": F.col("tmp_max") - F.col("tmp_min"), "surf_tmp": tmp + 1.0,
        "wind_range": F.col("wind_max") - F.col("wind_min")})


def _moved_year(r: Column, d: Column) -> Column:
    """Years are shifted by ``region % 4`` so that every leap phase occurs."""
    return (F.year(d) + r % 4).cast("long")


def _score(r: Column, i: Column) -> Column:
    week = (i - i % 7) / 7
    return (
        F.when((i >= TRAIN_DAYS) | (i % 7 != 6), F.lit(None).cast("double"))
        .when((r * 31 + week * 17) % 10 < 6, F.lit(0.0))
        .otherwise(1.0 + ((r * 7 + week * 13) % 9) / 2.0)
    )


def week_pieces(runs: DataFrame, days: int) -> DataFrame:
    """Filled runs that hold throughout, cut at the borders of positional weeks: what ``weekly.roll_up`` needs of the first ``days`` days.

    ``days`` of a piece is how many days it has; ``score`` is that of its one scored day, if any, and
    ``ordinal`` that of its last day.
    """
    r, week = F.col("region_id"), F.col("week_idx")
    end = F.least(F.col("pos") + F.col("until") - F.col("day_idx"), F.lit(days))
    out = runs.filter(F.col("pos") < days).withColumn("_end", end)
    out = out.withColumn("week_idx", F.explode(F.sequence(F.floor(F.col("pos") / 7), F.floor((F.col("_end") - 1) / 7))))
    first, last = F.greatest(F.col("pos"), week * 7), F.least(F.col("_end"), week * 7 + 7) - 1
    shift = F.col("day_idx") - F.col("pos")
    out = out.select("region_id", "week_idx", *[c for c in MEASURES if c in runs.columns],
                     (last - first + 1).alias("days"), (first + shift).cast("int").alias("_i"), (last + shift).cast("int").alias("_j"))
    scored = F.col("_i") + 6 - F.col("_i") % 7
    d = F.date_add(F.lit(START), F.col("_j"))
    return out.withColumns({
        "score": F.when(scored <= F.col("_j"), _score(r, scored)),
        "ordinal": ordinal_of(_moved_year(r, d), F.month(d), F.dayofmonth(d))}).drop("_i", "_j")


def unfold(
    runs: DataFrame, hold: bool = False, value: Callable[[str, Column], Column] | None = None,
    only: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Runs with all measures as a daily panel with ``day_idx``, ``pos`` and ``ordinal``, without moving a row.

    The days after the first one of a run have no measures, unless ``hold`` says that the run has
    been filled and they hold throughout, or ``value`` gives them from the name and the number of days
    since the first one. ``only`` says from the ordinal, and columns of the runs, which days a reader wants.
    """
    off, r = F.col("_off"), F.col("region_id")
    out = runs.withColumn("_off", F.explode(F.sequence(F.lit(0), F.col("until") - F.col("day_idx") - 1)))
    i, d = F.col("day_idx") + off, F.col("_d")
    year, month, day = _moved_year(r, d), F.month(d), F.dayofmonth(d)
    value = value or (lambda c, off: F.col(c) if hold else F.when(off == 0, F.col(c)))
    measures = [value(c, off).alias(c) for c in MEASURES]
    if only is not None:
        at = F.date_add(F.lit(START), i)
        out = out.filter(only(ordinal_of(_moved_year(r, at), F.month(at), F.dayofmonth(at))))
    out = out.select("region_id", i.alias("day_idx"), (F.col("pos") + off).alias("pos"), F.date_add(F.lit(START), i).alias("_d"), *measures)
    return out.select(
        "region_id", format_date(year, month, day).alias("date"), "day_idx", *MEASURES, _score(r, F.col("day_idx")).alias("score"),
        ordinal_of(year, month, day).alias("ordinal"), "pos")


def order_line_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel with supplier as region and ship date as day.

    About four fifths of the region-days carry no order line, so their measures are missing.
    """
    return unfold(derived_measures(observed_days(spark, sf_dir))).drop("pos", "ordinal")


def train_part(daily: DataFrame) -> DataFrame:
    return daily.filter(F.col("day_idx") < TRAIN_DAYS).drop("day_idx")


def test_part(daily: DataFrame) -> DataFrame:
    return daily.filter(F.col("day_idx") >= TEST_START).drop("day_idx", "score")


def prediction_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic predictions per (fold, region, horizon) for every supplier."""
    r, f, h = F.col("region_id"), F.col("fold"), F.col("horizon")
    return (
        spark.read.parquet(f"{sf_dir}/supplier.parquet")
        .select(F.col("s_suppkey").alias("region_id"),
                F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold"))
        .withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(5))))
        .withColumn("pred_a", ((r * 13 + h * 7 + f * 3) % 51) / 10.0)
        .withColumn("prob_b", ((r * 29 + h * 11 + f * 5) % 101) / 100.0)
        .withColumn("y_true", ((r * 17 + h * 5) % 11) / 2.0)
    )
