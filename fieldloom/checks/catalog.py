"""Every operator as a query over the given tables, with its SQL counterpart where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..constants import (
    BOX_FEATURES, CLIPPED, CLUSTER_FEATURES_V51, CLUSTER_FEATURES_V54, COMPARED_FEATURES, DENSITY_FEATURES,
    DROUGHT_FEATURES, LAGGED, LEVELS, MEASURES, PANEL_FEATURES, PERCENTS, PROFILE_FEATURES, SEVERITY_BINS, SHARE_BINS,
    UNUSED_BY_MODEL,
)
from ..functions import calendar as cal, scalars
from ..operators import (
    clean, climatology, distributions as dist, encoding, ensemble as ens, explore, features, hurdle, impute, ranks,
    regions, weekly as wk, windows,
)
from ..operators.splits import attach
from ..plans import modelling, preprocess as plan
from ..session import shared_folder, stage
from ..sources import panel, tables
from . import inputs as src
from .oracle import (
    CONTINUOUS, INDEX51, INDEX54, average_rank, big, each, long, q, qs, query,
)

Run = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    run: Run
    sql: str | None


CATALOG: dict[str, Entry] = {}


def rounded(x: Column, digits: int) -> Column:
    """As DuckDB rounds. ``F.round`` goes through decimal text, which took a third of the time of wide results. Kept short, so
    that the method Spark makes of a wide row is one that the JVM still compiles."""
    scale = float(10 ** digits)
    return F.rint(x * scale) / scale


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round doubles like the SQL side and widen small integers."""
    def one(f):
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return (rounded(c.cast("double") + 2.3e-9, digits) + 0.0).alias(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return c.cast("long").alias(f.name)
        return c
    return df.select(*[one(f) for f in df.schema])


def register(name: str, sql: str | None = None, digits: int = 4):
    def wrap(fn: Run) -> Run:
        CATALOG[name] = Entry(lambda spark, sf_dir: tidy(fn(spark, sf_dir), digits), query(sql) if sql else None)
        return fn
    return wrap


# --- sources and sinks ----------------------------------------------------------------------
ALL = ["region_id", "date", *MEASURES, "score"]


@register("s1_panel_csv", f"select region_id, date, {qs(MEASURES + ['score'], 6)} from p_train", 6)
def _(spark, sf):
    path = f"{shared_folder(spark)}/fieldloom/csv"
    name = stage(src.train(spark, sf).select(*ALL), "csv-source")
    folder = f"{path}-{spark.sparkContext.applicationId}-{sf.strip('/').replace('/', '_')}"
    tables.write_panel(name, folder, "csv")
    return panel.read_panel_csv(spark, folder)


@register("s2_pruned_read", f"select region_id, date, {qs(['prec', 'tmp', 'humidity', 'wind', 'score'], 6)} from p_train", 6)
def _(spark, sf):
    return panel.profile_columns(src.train(spark, sf)).select("region_id", "date", "prec", "tmp", "humidity", "wind", "score")


def _folder(spark, sf, name):
    return f"{shared_folder(spark)}/fieldloom/{name}-{spark.sparkContext.applicationId}-{sf.strip('/').replace('/', '_')}"


@register("s3_export_processed", f"select region_id, week_idx, {qs(['prec', 'tmp', 'score'])} from m54_train")
def _(spark, sf):
    folder = _folder(spark, sf, "processed")
    tables.export_processed(*src.panels(spark, sf, "v54"), folder)
    return spark.read.parquet(f"{folder}/train").select("region_id", "week_idx", "prec", "tmp", "score")


@register("s4_region_stats_file", f"select region_id, {qs(CLUSTER_FEATURES_V54)} from stats54")
def _(spark, sf):
    folder = _folder(spark, sf, "stats")
    tables.write_region_stats(_stats54(spark, sf).drop("cluster_id"), folder)
    return tables.read_table(spark, f"{folder}/region_stats")


@register("s5_read_processed", f"select region_id, week_idx, {qs(['prec', 'tmp'])} from m54_test")
def _(spark, sf):
    folder = _folder(spark, sf, "processed-again")
    tables.export_processed(*src.panels(spark, sf, "v54"), folder)
    _, test, stats = tables.read_processed(spark, folder)
    assert stats is None
    return test.select("region_id", "week_idx", "prec", "tmp")


def _csv_round_trip(spark, sf):
    folder = _folder(spark, sf, "processed-csv")
    tables.export_processed(*src.panels(spark, sf, "v51"), folder, "csv")
    tables.write_region_stats(_stats54(spark, sf).drop("cluster_id"), folder, "csv")
    return tables.read_processed(spark, folder, "csv")


S5_COLUMNS = ["prec", "surf_pre", "tmp", "humidity_week_std", "week_sin", "deficit", "tmp_anomaly"]


@register("s5_read_csv_train", f"select region_id, week_idx, week_end_date, day_ordinal, {qs(S5_COLUMNS + ['score'])} from m51_train")
def _(spark, sf):
    return _csv_round_trip(spark, sf)[0].select("region_id", "week_idx", "week_end_date", "day_ordinal", *S5_COLUMNS, "score")


@register("s5_read_csv_test", f"select region_id, week_idx, week_end_date, day_ordinal, {qs(S5_COLUMNS)} from m51_test")
def _(spark, sf):
    return _csv_round_trip(spark, sf)[1].select("region_id", "week_idx", "week_end_date", "day_ordinal", *S5_COLUMNS)


@register("s5_read_csv_stats", f"select region_id, {qs(CLUSTER_FEATURES_V54)} from stats54")
def _(spark, sf):
    return _csv_round_trip(spark, sf)[2]


@register("s2_pruned_read_csv", f"select region_id, date, {qs(['prec', 'tmp', 'humidity', 'wind'], 6)} from p_test", 6)
def _(spark, sf):
    """The header of a file without score decides what is read."""
    folder = _folder(spark, sf, "test-csv")
    tables.write_panel(src.test(spark, sf).select("region_id", "date", *MEASURES), folder, "csv")
    return panel.profile_columns(panel.read_panel_csv(spark, folder), with_score=True)


@register("s6_prediction_table", "select region_id, fold, horizon, " + qs(["pred_a", "prob_b"]) + " from preds")
def _(spark, sf):
    path = _folder(spark, sf, "predictions")
    tables.write_predictions(panel.prediction_fixture(spark, sf).drop("y_true"), path)
    return tables.read_predictions(spark, path).select("region_id", "fold", "horizon", "pred_a", "prob_b")


@register("s8_submission_file", "select region_id, " + ", ".join(
    f"max(case when horizon = {h} then round_even(least(greatest(case when prob < 0.5 then 0.0 else severity end, 0.0), 5.0), 0) end) as pred_week{h}"
    for h in range(1, 6)) + " from merged group by region_id")
def _(spark, sf):
    path = tables.write_submission(modelling.infer(panel.prediction_fixture(spark, sf)), _folder(spark, sf, "submission"), "MANUAL_0.50")
    return spark.read.option("header", True).schema(
        "region_id long, " + ", ".join(f"pred_week{h} double" for h in range(1, 6))).csv(path)


@register("s9_read_submissions", "select grp, " + q("value") + " from subs where grp in ('hard50', 'soft')")
def _(spark, sf):
    folder = _folder(spark, sf, "submissions")
    preds = panel.prediction_fixture(spark, sf)
    paths = {m: tables.write_submission(modelling.infer(preds, mode), folder, m) for m, mode in (("hard50", "HARD"), ("soft", "SOFT"))}
    return tables.read_submissions(spark, {**paths, "absent": f"{folder}/absent"})


# --- calendar ---------------------------------------------------------------------------------
@register("c1_parse_date", "select region_id, date, y, m, d from p_train")
def _(spark, sf):
    return src.train(spark, sf).select("region_id", "date", cal.year_of("date").alias("y"), cal.month_of("date").alias("m"), cal.day_of("date").alias("d"))


@register("c2_year_slot", "select region_id, date, doy from p_train")
def _(spark, sf):
    return src.train(spark, sf).select("region_id", "date", cal.year_slot("date").alias("doy"))


@register("c3_ordinal", "select region_id, date, ordinal from p_train")
def _(spark, sf):
    return src.train(spark, sf).select("region_id", "date", cal.ordinal("date").alias("ordinal"))


@register("c4_days_in_month", """select region_id, date, cast(case when m = 2 then case when y % 4 = coalesce(phase, 1) then 29 else 28 end
  when m in (4,6,9,11) then 30 else 31 end as bigint) as days from p_train left join p_phase using (region_id)""")
def _(spark, sf):
    df = src.train(spark, sf)
    return attach(df, climatology.leap_phases(df), "pos").select(
        "region_id", "date", cal.days_in_month(cal.year_of("date"), cal.month_of("date"), F.col("phase")).alias("days"))


@register("c5_subtract_days", """select t.region_id, t.date, concat(cast(b.y as varchar), '-', lpad(cast(b.m as varchar),2,'0'), '-', lpad(cast(b.d as varchar),2,'0')) as earlier
from p_train t left join p_phase p using (region_id) join p_calendar a on a.phase = coalesce(p.phase, 1) and a.y = t.y and a.m = t.m and a.d = t.d
join p_calendar b on b.phase = a.phase and b.k = a.k - (t.pos % 49 + 1)""")
def _(spark, sf):
    df = src.train(spark, sf)
    return attach(df, climatology.leap_phases(df), "pos").select(
        "region_id", "date", cal.subtract_days("date", F.col("pos") % 49 + 1, F.col("phase")).alias("earlier"))


@register("c6_leap_phase", "select region_id, phase from p_phase")
def _(spark, sf):
    return climatology.leap_phases(src.train(spark, sf))


@register("c7_format_date", "select region_id, pos, date from p_test")
def _(spark, sf):
    parts = [p("date") for p in (cal.year_of, cal.month_of, cal.day_of)]
    return src.test(spark, sf).select("region_id", "pos", cal.format_date(*parts).alias("date"))


@register("c8_cyclic", "select region_id, date, " + q("sin(2.0*pi()*doy/365.25)", "week_sin", 6) + ", " + q("cos(2.0*pi()*doy/365.25)", "week_cos", 6) + " from p_train", 6)
def _(spark, sf):
    a = cal.week_angle("date")
    return src.train(spark, sf).select("region_id", "date", F.sin(a).alias("week_sin"), F.cos(a).alias("week_cos"))


# --- imputation ----------------------------------------------------------------------------------
DAY = ["region_id", "date"]


@register("i1_ffill_bfill", f"select region_id, date, {qs(MEASURES, 6)} from f51_train", 6)
def _(spark, sf):
    return src.filled_train(spark, sf, "v51").select(*DAY, *MEASURES)


@register("i2_ffill_limit3", f"select region_id, date, {qs(CONTINUOUS, 6)} from s54_train", 6)
def _(spark, sf):
    return panel.unfold(src.held_train(spark, sf)[0], value=lambda c, off: impute.held_value(c, off) if c in CONTINUOUS else F.lit(None)).select(*DAY, *CONTINUOUS)


@register("i3_region_mean", f"select region_id, date, {qs(CONTINUOUS)} from r54_train")
def _(spark, sf):
    return src.region_filled_train(spark, sf).select(*DAY, *CONTINUOUS)


@register("i4_global_mean", f"select region_id, date, {qs(CONTINUOUS)} from f54_test")
def _(spark, sf):
    return impute.fill_climate(src.test(spark, sf)).select(*DAY, *CONTINUOUS)


@register("i4_blank_regions", f"select region_id, date, {qs(CONTINUOUS)} from b_filled")
def _(spark, sf):
    """Every tenth region has no measure at all."""
    blank = src.test(spark, sf).withColumns({c: F.when(F.col("region_id") % 10 != 3, F.col(c)) for c in CONTINUOUS})
    return impute.fill_climate(blank).select(*DAY, *CONTINUOUS)


@register("i4_overall_mean_only", "select region_id, date, " + ", ".join(q(f"coalesce({c}, avg({c}) over ())", c) for c in CONTINUOUS) + " from p_test")
def _(spark, sf):
    return impute.fill_global_mean(src.test(spark, sf), CONTINUOUS).select(*DAY, *CONTINUOUS)


@register("i5_zero_fill", "select region_id, date, " + q("coalesce(prec, 0)", "prec", 6) + ", " + q("coalesce(surf_pre, 0)", "surf_pre", 6) + " from p_train", 6)
def _(spark, sf):
    return impute.fill_zero(src.train(spark, sf)).select(*DAY, "prec", "surf_pre")


@register("i6_ffill_zero", "select region_id, week_idx, " + q("coalesce(last_value(x ignore nulls) over (partition by region_id order by week_idx rows between unbounded preceding and current row), 0)", "x")
          + " from (select region_id, week_idx, case when (region_id + week_idx) % 3 = 0 then tmp end as x from w51_test)")
def _(spark, sf):
    df = src.weekly(spark, sf, "v51")[1].select(
        "region_id", "week_idx", F.when((F.col("region_id") + F.col("week_idx")) % 3 == 0, F.col("tmp")).alias("x"))
    return impute.fill_or_zero(df, ["x"]).select("region_id", "week_idx", "x")


@register("i7_drop_incomplete", f"select region_id, date, {qs(['prec', 'score'], 6)} from p_train where score is not null and tmp is not null", 6)
def _(spark, sf):
    return impute.drop_incomplete(src.train(spark, sf), ["tmp", "score"]).select(*DAY, "prec", "score")


@register("i8_null_counts", each("select '@' as \"column\", count(*) - count(@) as nulls from p_train", MEASURES + ["score"], " union all "))
def _(spark, sf):
    return impute.null_counts(src.train(spark, sf), MEASURES + ["score"])


# --- filters, clips, scalars ------------------------------------------------------------------------
@register("f1_zclip", f"select region_id, date, {qs(CLIPPED)} from c51_train")
def _(spark, sf):
    return clean.clip_outliers(src.filled_train(spark, sf, "v51")).select(*DAY, *CLIPPED)


@register("f2_lower_clip", "select region_id, date, " + q("case when tmp < 0 then 0.0 else tmp end", "tmp", 6) + " from p_train", 6)
def _(spark, sf):
    return clean.not_below_zero(src.train(spark, sf), ["tmp"]).select(*DAY, "tmp")


@register("f3_log_rain", "select region_id, week_idx, " + each("round(cast(ln(1 + case when @ < 0 then 0.0 else @ end) as double) + 2.3e-9, 6) + 0.0 as @", ["prec", "prec_week_max"]) + " from w51_train", 6)
def _(spark, sf):
    return clean.log_rain_columns(src.weekly_train(spark, sf, "v51")).select("region_id", "week_idx", "prec", "prec_week_max")


@register("f3_log_rain_rolled", "select region_id, week_idx, " + each("round(cast(ln(1 + case when @ < 0 then 0.0 else @ end) as double) + 2.3e-9, 6) + 0.0 as @", ["prec", "prec_week_max", "prec_roll_sum_4w"])
          + " from (select region_id, week_idx, prec, prec_week_max, sum(prec) over (partition by region_id order by week_idx rows between 3 preceding and current row) as prec_roll_sum_4w from w51_train)", 6)
def _(spark, sf):
    """All three columns, the rolled one made first."""
    return clean.log_rain_columns(features.rolling(_train_w(spark, sf, "v51"))).select("region_id", "week_idx", "prec", "prec_week_max", "prec_roll_sum_4w")


@register("f4_drop_columns", f"select region_id, week_idx, {qs(['tmp_max', 'wind_min'])} from w51_train")
def _(spark, sf):
    out = clean.drop_unused(src.weekly_train(spark, sf, "v51"))
    assert not set(UNUSED_BY_MODEL) & set(out.columns)
    return out.select("region_id", "week_idx", "tmp_max", "wind_min")


@register("f5_keep_first_days", "select region_id, pos, date from p_train where pos between 0 and 2400")
def _(spark, sf):
    return clean.keep_first_days(src.train(spark, sf), panel.KEEP_DAYS_HERE).select("region_id", "pos", "date")


@register("f6_strip_padding", "select region_id, week_idx - 3 as week_idx, " + q("tmp") + " from w51_test where week_idx >= 3")
def _(spark, sf):
    return clean.strip_padding(src.weekly(spark, sf, "v51")[1], 3).select("region_id", "week_idx", "tmp")


@register("f7_cohort_means", "select " + ", ".join(q(f"avg(case when {cond} then {c} end)", f"{name}_{c}") for name, cond in (("safe", "score = 0"), ("ext", "score > 3.5")) for c in ("prec", "tmp")) + " from p_train")
def _(spark, sf):
    return src.train(spark, sf).agg(*[
        F.avg(F.when(cond, F.col(c))).alias(f"{name}_{c}")
        for name, cond in (("safe", F.col("score") == 0), ("ext", F.col("score") > 3.5)) for c in ("prec", "tmp")])


@register("f8_bound_round", "select region_id, fold, horizon, " + q("round_even(least(greatest(pred_a, 0.0), 5.0), 0)", "pred") + " from preds")
def _(spark, sf):
    return panel.prediction_fixture(spark, sf).select("region_id", "fold", "horizon", F.rint(scalars.bounded_score(F.col("pred_a"))).alias("pred"))


# --- padding -----------------------------------------------------------------------------------------
@register("p1_climatology", f"select region_id, doy, {qs(MEASURES)} from clim51")
def _(spark, sf):
    return climatology.climatology(src.clean_train(spark, sf, "v51"))


@register("p2_global_means", f"select {qs(MEASURES)} from means51")
def _(spark, sf):
    return climatology.global_means(src.clean_train(spark, sf, "v51"))


@register("p3_pad_days", "select region_id, date, pos from pad54")
def _(spark, sf):
    return climatology.pad_days(src.test(spark, sf), climatology.leap_phases(src.train(spark, sf)), 49).drop("ordinal")


@register("p4_filled_pad", f"select region_id, date, {qs(MEASURES)} from filled_pad51")
def _(spark, sf):
    return climatology.fill_pad(*src.pad(spark, sf, "v51")).drop("pos", "ordinal")


@register("p4_pad_misses", f"select region_id, date, {qs(MEASURES)} from gap_pad")
def _(spark, sf):
    """A third of the slots is missing from the climatology."""
    pad, known, means = src.pad(spark, sf, "v51")
    known = known.filter((F.col("region_id") + F.col("doy")) % 3 != 0)
    return climatology.fill_pad(pad, known, means).select("region_id", "date", *MEASURES)


@register("p5_prepend", "select region_id, date, pos from padded51")
def _(spark, sf):
    train, test = src.clean(spark, sf, "v51")
    pad = climatology.pad_days(test, climatology.leap_phases(train), 21)
    return climatology.prepend(pad, test, 21).select("region_id", "date", "pos")


@register("p6_climatology_pad", f"select region_id, date, pos, {qs(MEASURES)} from padded51")
def _(spark, sf):
    return src.padded_test(spark, sf, "v51").select("region_id", "date", "pos", *MEASURES)


@register("p6_climatology_pad_v54", f"select region_id, date, pos, {qs(MEASURES)} from padded54")
def _(spark, sf):
    return src.padded_test(spark, sf, "v54").select("region_id", "date", "pos", *MEASURES)


# --- roll-up ----------------------------------------------------------------------------------------------
WEEK = ["region_id", "week_idx"]
SPREADS = [f"{c}{s}" for c in ("humidity", "tmp", "wind") for s in ("", "_week_max", "_week_min", "_week_std")]
SUMS = [f"{c}{s}" for c in ("prec", "surf_pre") for s in ("", "_week_max")]
MEANS = ["tmp_max", "tmp_min", "tmp_range", "surf_tmp", "wind_max", "wind_min", "wind_range"]
ROLLED = SUMS + SPREADS + MEANS + ["week_sin", "week_cos"]


def _rolled(spark, sf, cols):
    return src.weekly_train(spark, sf, "v51").select(*WEEK, *cols)


@register("a1_week_index", "select region_id, date, pos // 7 as week_idx from p_train")
def _(spark, sf):
    return wk.week_index(src.train(spark, sf)).select("region_id", "date", "week_idx")


@register("a2_week_sums", f"select region_id, week_idx, {qs(SUMS)} from (select region_id, pos//7 as week_idx, " + each("coalesce(sum(@),0) as @, max(@) as @_week_max", ["prec", "surf_pre"]) + " from p_train where pos between 0 and 2400 group by all)")
def _(spark, sf):
    return wk.roll_up(clean.keep_first_days(src.train(spark, sf), panel.KEEP_DAYS_HERE)).select(*WEEK, *SUMS)


@register("a3_week_spreads", f"select region_id, week_idx, {qs(SPREADS)} from w51_train")
def _(spark, sf):
    return _rolled(spark, sf, SPREADS)


@register("a4_week_means", f"select region_id, week_idx, {qs(MEANS)} from w51_train")
def _(spark, sf):
    return _rolled(spark, sf, MEANS)


@register("a5_week_score_end", "select region_id, week_idx, " + q("score") + ", week_end_date from w51_train")
def _(spark, sf):
    return _rolled(spark, sf, ["score", "week_end_date"])


@register("a6_weekly_rollup", f"select region_id, week_idx, {qs(ROLLED)}, {q('score')}, week_end_date, day_ordinal from w51_train")
def _(spark, sf):
    return _rolled(spark, sf, [*ROLLED, "score", "week_end_date", "day_ordinal"])


@register("a6_weekly_rollup_test", f"select region_id, week_idx, {qs(ROLLED)}, week_end_date, day_ordinal from w54_test")
def _(spark, sf):
    return wk.roll_up(src.padded_test(spark, sf, "v54")).select(*WEEK, *ROLLED, "week_end_date", "day_ordinal")


# --- window features -----------------------------------------------------------------------------------------
def _train_w(spark, sf, v="v51"):
    return src.weekly_train(spark, sf, v)


ROLLS = ["prec_roll_sum_4w", "tmp_roll_mean_4w", "humidity_roll_mean_4w"]
LAG_COLS = [f"{c}_lag{k}w" for c in LAGGED for k in (1, 2)]
SHORT = ["water_shortage_roll_cum_4w", "water_shortage_roll_cum_8w"]


@register("w1_roll4", f"select region_id, week_idx, {qs(ROLLS)} from x51_train")
def _(spark, sf):
    return features.rolling(_train_w(spark, sf)).select(*WEEK, *ROLLS)


@register("w2_lags", f"select region_id, week_idx, {qs(LAG_COLS)} from x51_train")
def _(spark, sf):
    return features.lags(_train_w(spark, sf)).select(*WEEK, *LAG_COLS)


@register("w3_deficit_cum", f"select region_id, week_idx, {qs(['deficit_roll_cum_4w'])} from x51_train")
def _(spark, sf):
    return features.deficit_sums(features.water_balance(_train_w(spark, sf))).select(*WEEK, "deficit_roll_cum_4w")


@register("w3_shortage_cum", f"select region_id, week_idx, {qs(SHORT)} from x54_train")
def _(spark, sf):
    return features.shortage_sums(features.shortage(_train_w(spark, sf, "v54"))).select(*WEEK, *SHORT)


@register("w4_dry_spell", "select region_id, week_idx, is_dry_spell from x54_train")
def _(spark, sf):
    return features.dry_spell(_train_w(spark, sf, "v54")).select(*WEEK, "is_dry_spell")


@register("w5_momentum", "select region_id, week_idx, " + q("shortage_momentum", None, 2) + " from x54_train", 2)
def _(spark, sf):
    return features.momentum(features.shortage(_train_w(spark, sf, "v54"))).select(*WEEK, "shortage_momentum")


@register("w6_anomaly", f"select region_id, week_idx, {q('tmp_anomaly')} from z51_train")
def _(spark, sf):
    df = _train_w(spark, sf)
    return features.anomaly(df, features.fit_anomaly(df)).select(*WEEK, "tmp_anomaly")


UNSEEN_SQL = """select t.region_id, t.week_idx, {} from w51_test t join own51 using (region_id)
left join (select * from fit51 where region_id % 4 <> 1) f on f.region_id = t.region_id"""


@register("w7_anomaly_unseen", UNSEEN_SQL.format(q("(tmp - case when f.region_id is null then own_mu else mu end)/case when f.region_id is null then 1.0 else sd end", "tmp_anomaly")))
def _(spark, sf):
    train, test = src.weekly(spark, sf, "v51")
    seen = features.fit_anomaly(train).filter(F.col("region_id") % 4 != 1)  # the others act as unseen
    return features.anomaly(test, features.fit_anomaly_for_test(test, seen)).select(*WEEK, "tmp_anomaly")


@register("w8_size_violations", "select region_id, count(*) as n from p_train group by region_id having count(*) <> 2405")
def _(spark, sf):
    return features.size_violations(src.train(spark, sf), panel.TRAIN_DAYS)


@register("w8_cohort_counts", " union all ".join(
    f"select '{c}' as cohort, count(*) as regions, (select count(*) from supplier) as expected, min(n) as rows_min, max(n) as rows_max, count(*) filter (where n <> {n}) as violations from (select region_id, count(*) as n from p_{c} group by region_id)"
    for c, n in (("train", panel.TRAIN_DAYS), ("test", 91))))
def _(spark, sf):
    expected = spark.read.parquet(f"{sf}/supplier.parquet").count()
    return features.cohort_counts(src.train(spark, sf), src.test(spark, sf), expected, panel.TRAIN_DAYS, 91)


# --- index features ----------------------------------------------------------------------------------------------
PET = "0.55 * case when tmp < 0 then 0.0 else tmp end"


@register("d1_pet", "select region_id, week_idx, " + q("pet") + " from x51_train")
def _(spark, sf):
    return features.water_balance(_train_w(spark, sf)).select(*WEEK, "pet")


@register("d2_deficit", "select region_id, week_idx, " + q("deficit") + " from x51_train")
def _(spark, sf):
    return features.water_balance(_train_w(spark, sf)).select(*WEEK, "deficit")


@register("d3_shortage", "select region_id, week_idx, " + q("water_shortage") + " from x54_train")
def _(spark, sf):
    return features.shortage(_train_w(spark, sf, "v54")).select(*WEEK, "water_shortage")


@register("d4_aridity", "select region_id, week_idx, " + q("aridity_index") + " from x51_train")
def _(spark, sf):
    return features.heat(_train_w(spark, sf)).select(*WEEK, "aridity_index")


@register("d5_heat_shock", "select region_id, week_idx, " + q("heat_shock") + " from x51_train")
def _(spark, sf):
    return features.heat(_train_w(spark, sf)).select(*WEEK, "heat_shock")


@register("d6_cross", "select region_id, week_idx, " + q("cross_shortage_x_anomaly", None, 3) + " from i54_train", 3)
def _(spark, sf):
    df = _train_w(spark, sf, "v54")
    return features.index_v54(df, features.fit_anomaly(df), True).select(*WEEK, "cross_shortage_x_anomaly")


@register("d7_raw_proxies", f"select region_id, date, {qs(['pet_raw', 'vpd_raw'])} from raw_train")
def _(spark, sf):
    return explore.with_proxies(src.train(spark, sf)).select(*DAY, "pet_raw", "vpd_raw")


def _index(spark, sf, v, cohort):
    train, test = src.weekly(spark, sf, v)
    stats = features.fit_anomaly(train)
    op = features.index_v51 if v == "v51" else features.index_v54
    return op(train, stats, True) if cohort == "train" else op(test, stats, False)


@register("d8_index_v51", f"select region_id, week_idx, {qs(INDEX51)} from i51_train")
def _(spark, sf):
    return _index(spark, sf, "v51", "train").select(*WEEK, *INDEX51)


def _gap_index(spark, sf, v):
    """The test cohort with missing temperatures, also in the first week."""
    train, test = src.weekly(spark, sf, v)
    gap = (F.col("region_id") % 2 == 0) & (F.col("week_idx") % 5 < 2)
    op = features.index_v51 if v == "v51" else features.index_v54
    return op(test.withColumn("tmp", F.when(~gap, F.col("tmp"))), features.fit_anomaly(train), False)


@register("d8_index_v51_gaps", f"select region_id, week_idx, {qs(INDEX51)} from g51_filled")
def _(spark, sf):
    return _gap_index(spark, sf, "v51").select(*WEEK, *INDEX51)


@register("d9_index_v54_gaps", f"select region_id, week_idx, {qs(INDEX54, 2)} from g54_filled", 2)
def _(spark, sf):
    return _gap_index(spark, sf, "v54").select(*WEEK, *INDEX54)


@register("d8_index_v51_test", f"select region_id, week_idx, {qs(INDEX51)} from j51_test")
def _(spark, sf):
    return _index(spark, sf, "v51", "test").select(*WEEK, *INDEX51)


IDX54 = [c for c in INDEX54 if c != "is_dry_spell"]


@register("d9_index_v54", f"select region_id, week_idx, is_dry_spell, {qs(IDX54, 2)} from i54_train", 2)
def _(spark, sf):
    return _index(spark, sf, "v54", "train").select(*WEEK, "is_dry_spell", *IDX54)


@register("d9_index_v54_test", f"select region_id, week_idx, cast(is_dry_spell as bigint) as is_dry_spell, {qs(IDX54, 2)} from j54_test", 2)
def _(spark, sf):
    return _index(spark, sf, "v54", "test").select(*WEEK, "is_dry_spell", *IDX54)


PANEL51 = ROLLED + ROLLS + LAG_COLS + INDEX51
PANEL54 = ROLLED + ROLLS + IDX54


@register("preprocess_v51_train", f"select region_id, week_idx, {qs(PANEL51)}, {q('score')}, week_end_date, day_ordinal from m51_train")
def _(spark, sf):
    out = src.train_panel(spark, sf, "v51")
    return out.select(*WEEK, *PANEL51, "score", "week_end_date", "day_ordinal")


@register("preprocess_v51_test", f"select region_id, week_idx, {qs(PANEL51)}, week_end_date, day_ordinal from m51_test")
def _(spark, sf):
    return src.panels(spark, sf, "v51")[1].select(*WEEK, *PANEL51, "week_end_date", "day_ordinal")


@register("preprocess_v54_train", f"select region_id, week_idx, is_dry_spell, {qs(PANEL54, 2)}, {q('score')}, week_end_date, day_ordinal from m54_train", 2)
def _(spark, sf):
    out = src.train_panel(spark, sf, "v54")
    return out.select(*WEEK, "is_dry_spell", *PANEL54, "score", "week_end_date", "day_ordinal")


@register("preprocess_v54_test", f"select region_id, week_idx, cast(is_dry_spell as bigint) as is_dry_spell, {qs(PANEL54, 2)}, week_end_date, day_ordinal from m54_test", 2)
def _(spark, sf):
    return src.panels(spark, sf, "v54")[1].select(*WEEK, "is_dry_spell", *PANEL54, "week_end_date", "day_ordinal")


# --- regions --------------------------------------------------------------------------------------------------------
def _stats54(spark, sf):
    # From the weekly roll-up: rain is not yet on the log scale there.
    return regions.region_stats_v54(_train_w(spark, sf, "v54")).withColumn("cluster_id", F.col("region_id") % 10)


def _stats51(spark, sf):
    return regions.region_stats_v51(_train_w(spark, sf))


STATS51_SQL = """select region_id, coalesce(avg(score), 0) as score_mean, coalesce(avg(case when score = 0 then 1.0 when score is not null then 0.0 end), 0.5) as score_zero_prob,
coalesce(stddev_samp(score), 0) as score_std, avg(tmp) as tmp_mean, avg(prec) as prec_mean from w51_train group by region_id"""


@register("k1_region_stats", f"select region_id, {qs(CLUSTER_FEATURES_V51)} from ({STATS51_SQL})")
def _(spark, sf):
    return _stats51(spark, sf)


@register("k2_region_stats_v54", f"select region_id, {qs(CLUSTER_FEATURES_V54)} from stats54")
def _(spark, sf):
    return _stats54(spark, sf).drop("cluster_id")


@register("k3_standardise", "select region_id, " + ", ".join(q(f"({c} - avg({c}) over ())/stddev_pop({c}) over ()", c) for c in CLUSTER_FEATURES_V51) + f" from ({STATS51_SQL})")
def _(spark, sf):
    return regions.standardise(stage(_stats51(spark, sf), "region-stats"), CLUSTER_FEATURES_V51)


def _clusters(spark, sf):
    return src.stored(spark, sf, "clusters", lambda: stage(regions.cluster_regions(stage(_stats51(spark, sf), "region-stats")), "clusters"))


@register("k4_cluster_regions")
def _(spark, sf):
    return _clusters(spark, sf)


@register("k4_cluster_checks", "select count(distinct region_id) as regions, cast(10 as bigint) as clusters, cast(0 as bigint) as nearer_elsewhere, cast(0 as bigint) as out_of_order from m51_train")
def _(spark, sf):
    """Regions nearer to the mean of another cluster, and clusters not numbered from wet to dry."""
    z = regions.standardise(stage(_stats51(spark, sf), "region-stats"), CLUSTER_FEATURES_V51)
    z = z.join(_clusters(spark, sf).select("region_id", "cluster_id"), "region_id")
    means = z.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in CLUSTER_FEATURES_V51]).collect()  # ten rows
    centres = {r["cluster_id"]: [r[c] for c in CLUSTER_FEATURES_V51] for r in means}
    far = {k: sum((F.col(c) - v) * (F.col(c) - v) for c, v in zip(CLUSTER_FEATURES_V51, at)) for k, at in centres.items()}
    best, own = F.least(*far.values()), F.coalesce(*[F.when(F.col("cluster_id") == k, d) for k, d in far.items()])
    order = _clusters(spark, sf).groupBy("cluster_id").agg(F.avg("prec_mean").alias("wet"))
    later = order.select(F.col("cluster_id").alias("next"), F.col("wet").alias("next_wet"))
    turned = order.join(later, F.col("next") == F.col("cluster_id") + 1).agg(
        F.count(F.when(F.col("next_wet") > F.col("wet"), 1))).scalar()
    return z.agg(F.count(F.lit(1)).alias("regions"), F.countDistinct("cluster_id").alias("clusters"), F.count(
        F.when(own > best + 1e-6, 1)).alias("nearer_elsewhere")).withColumn("out_of_order", turned)


def _given_clusters(spark, sf):
    """An arithmetic assignment that leaves out every third region."""
    return src.train(spark, sf).select("region_id").distinct().filter("region_id % 3 <> 0").withColumn("cluster_id", F.col("region_id") * 7 % 10)


GIVEN = "(select distinct region_id, region_id * 7 % 10 as cluster_id from p_train where region_id % 3 <> 0)"


@register("k5_cluster_sizes", f"select cluster_id, count(*) as regions from {GIVEN} group by cluster_id")
def _(spark, sf):
    return regions.cluster_sizes(_given_clusters(spark, sf)).select("cluster_id", F.col("regions"))


@register("k6_assign_clusters", f"select w.region_id, w.week_idx, coalesce(c.cluster_id, 0) as cluster_id from m51_test w left join {GIVEN} c using (region_id)")
def _(spark, sf):
    return regions.assign_clusters(src.panels(spark, sf, "v51")[1], _given_clusters(spark, sf)).select(*WEEK, "cluster_id")


def _finished(spark, sf, variant, side):
    """The whole of ``preprocess`` with its clusters; the label is arbitrary, so only its range is compared."""
    df = getattr(src.finished(spark, sf, variant), side)
    extra = ["score"] if side == "train" else []
    return df.select(*WEEK, *(PANEL51 if variant == "v51" else PANEL54), *extra, "week_end_date", "day_ordinal",
                     F.col("cluster_id").between(0, 9).alias("clustered"), F.lit(len(df.columns)).alias("columns"))


for _v, _side, _n in (("v51", "train", 48), ("v51", "test", 47)):
    register(f"preprocess_{_v}_{_side}_clustered", f"select region_id, week_idx, {qs(PANEL51 if _v == 'v51' else PANEL54)}" + (f", {q('score')}" if _side == "train" else "")
             + f", week_end_date, day_ordinal, true as clustered, cast({_n} as bigint) as columns from m{_v[1:]}_{_side}")(
        lambda spark, sf, v=_v, side=_side: _finished(spark, sf, v, side))


# --- windows, folds, encoding -----------------------------------------------------------------------------------------
@register("t1_flat_names", "select " + " || ',' || ".join(["cast(count(*) as varchar)", "'prec_w1'", "'prec_delta'"]) + " as names from t_rows")
def _(spark, sf):
    names = windows.flat_names(PANEL_FEATURES)
    n = src.samples(spark, sf).weekly.agg(F.count(F.lit(1)).cast("string").alias("n"))
    return n.select(F.concat_ws(",", "n", F.lit(names[0]), F.lit(names[-len(PANEL_FEATURES)])).alias("names"))


NAMES = "(select w*30 + i as pos, f || case when w < 13 then '_w' || (w + 1) else '_delta' end as name from (select range as w from range(0, 14)), (select unnest(range(30)) as i, unnest([" + ", ".join(f"'{c}'" for c in PANEL_FEATURES) + "]) as f))"


@register("t1_all_flat_names", f"select pos, name, (select count(*) from t_rows) as rows from {NAMES}")
def _(spark, sf):
    n = src.samples(spark, sf).weekly.agg(F.count(F.lit(1)).alias("rows"))
    names = F.array(*[F.lit(x) for x in windows.flat_names(PANEL_FEATURES)])
    return n.select("rows", F.posexplode(names).alias("pos", "name")).select("pos", "name", "rows")


@register("t2_refine_train", "select region_id, week_idx, " + qs(["prec", "tmp_anomaly", "wind_min"]) + " from m51_train where " + " and ".join(f"{c} is not null" for c in PANEL_FEATURES))
def _(spark, sf):
    return windows.refine(src.train_panel(spark, sf, "v51"), True).select(*WEEK, "prec", "tmp_anomaly", "wind_min")


@register("t2_refine_test", "select region_id, week_idx, " + qs(["prec", "tmp_anomaly", "wind_min"]) + " from m51_test")
def _(spark, sf):
    return windows.refine(src.panels(spark, sf, "v51")[1], False).select(*WEEK, "prec", "tmp_anomaly", "wind_min")


def _holes(df):
    """The panel with every feature missing in weeks of its own: about one row in twelve loses one."""
    gap = lambda i: (F.col("region_id") * 7 + F.col("week_idx") * 3 + i * 11) % 360 == 0
    return df.withColumns({c: F.when(~gap(i), F.col(c)) for i, c in enumerate(PANEL_FEATURES)})


def _holes_sql(table):
    return "select region_id, week_idx, " + ", ".join(
        f"case when (region_id*7 + week_idx*3 + {i * 11}) % 360 <> 0 then {c} end as {c}" for i, c in enumerate(PANEL_FEATURES)) + f" from {table}"


@register("t2_refine_train_gaps", f"select region_id, week_idx, {qs(PANEL_FEATURES)} from ({_holes_sql('m51_train')}) where " + " and ".join(f"{c} is not null" for c in PANEL_FEATURES))
def _(spark, sf):
    """Rows with a gap in any of the 30 columns are dropped."""
    return windows.refine(_holes(src.train_panel(spark, sf, "v51")), True).select(*WEEK, *PANEL_FEATURES)


@register("t2_refine_test_gaps", "select region_id, week_idx, " + ", ".join(q(f"coalesce(last_value({c} ignore nulls) over (partition by region_id order by week_idx rows between unbounded preceding and current row), 0)", c) for c in PANEL_FEATURES)
          + f" from ({_holes_sql('m51_test')})")
def _(spark, sf):
    """Gaps take the last known value of the region, or 0."""
    return windows.refine(_holes(src.panels(spark, sf, "v51")[1]), False).select(*WEEK, *PANEL_FEATURES)


NF = len(PANEL_FEATURES)


def _window_digest(df):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return df.select(
        "region_id", "start", "tgt_start", "tgt_end", *[F.col("y")[h].cast("double").alias(f"y{h + 1}") for h in range(5)],
        total(F.slice("x", 1, 13 * NF)).alias("x_sum"), total(F.slice("x", 13 * NF + 1, NF)).alias("d_sum"),
        F.col("x")[0].cast("double").alias("x_first"), F.col("x")[13 * NF - 1].cast("double").alias("x_last"))


YS = [f"y{h}" for h in range(1, 6)]
DIGEST = ["region_id", "start", "tgt_start", "tgt_end"]


@register("t3_windows", f"select {', '.join(DIGEST)}, {qs(YS + ['x_sum', 'd_sum', 'x_first', 'x_last'], 2)} from t_windows", 2)
def _(spark, sf):
    weekly = windows.renumber(windows.refine(src.train_panel(spark, sf, "v51"), True).dropna(subset=["score"]), whole=True)
    return _window_digest(windows.sliding_windows(weekly, PANEL_FEATURES))


def _elements(df, order, cols=PANEL_FEATURES):
    """Sum, weighted sum and extremes of each of the places of ``x``: a permutation would change them."""
    each_one = df.select(order.alias("o"), F.posexplode("x").alias("pos", "v"))
    v = F.col("v").cast("double")
    names = F.array(*[F.lit(x) for x in windows.flat_names(cols)])
    return each_one.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"), F.avg(v * F.col("o")).alias("weighted"), F.min(v).alias("low"),
        F.max(v).alias("high")).select(F.element_at(names, F.col("pos") + 1).alias("name"), "n", "total", "weighted", "low", "high")


def _elements_sql(rows, first, order, cols=PANEL_FEATURES):
    """The same from single rows: ``rows`` has w (week in the window, from 1) and the features."""
    per = ", ".join(f"{{'c': '{c}', 's': sum({c}::double), 'p': avg({c}::double * {order}), 'a': min({c})::double, 'b': max({c})::double}}" for c in cols)
    delta = ", ".join(f"l.{c} - f.{c} as {c}" for c in cols)
    return (f"select p.c || w as name, n, {q('p.s', 'total', 2)}, {q('p.p', 'weighted', 2)}, {q('p.a', 'low', 2)}, {q('p.b', 'high', 2)} from ("
            f"select '_w' || w as w, count(*) as n, unnest([{per}]) as p from ({rows}) group by w union all "
            f"select '_delta', count(*), unnest([{per}]) from (select l.o, {delta} from ({rows}) l join ({rows}) f on f.k = l.k and l.w = 13 and f.w = 1))")


T3_ROWS = "select w.region_id || '|' || w.start as k, w.start % 97 as o, r.pos - w.start + 1 as w, " + ", ".join(f"r.{c}" for c in PANEL_FEATURES) + " from t_windows w join t_rows r on r.region_id = w.region_id and r.pos between w.start and w.start + 12"


@register("t3_window_elements", _elements_sql(T3_ROWS, "k", "o"), 2)
def _(spark, sf):
    s = src.samples(spark, sf)
    return _elements(windows.sliding_windows(s.weekly, PANEL_FEATURES), F.col("start") % 97)


#: Every fourth region has three weeks only, so its first row is repeated.
SHORT_HISTORIES = "select * from m51_test where region_id % 4 <> 0 or week_idx < 3"
T4_ROWS = "select region_id as k, region_id % 97 as o, 13 - n + r as w, " + ", ".join(PANEL_FEATURES) + " from (select region_id, unnest(case when r = 1 then range(r - (13 - n), r + 1) else [r] end) as r, n, " + ", ".join(PANEL_FEATURES) + " from (select region_id, " + ", ".join(f"cast({c} as real) as {c}" for c in PANEL_FEATURES) + f", row_number() over (partition by region_id order by week_idx) as r, count(*) over (partition by region_id) as n from ({SHORT_HISTORIES})))"


@register("t4_last_window_elements", _elements_sql(T4_ROWS, "k", "o"), 2)
def _(spark, sf):
    test = src.panels(spark, sf, "v51")[1].filter("region_id % 4 <> 0 or week_idx < 3")
    last = windows.last_windows(windows.refine(test, False), PANEL_FEATURES)
    return _elements(last, F.col("region_id") % 97)


@register("t4_last_windows", "select region_id, " + q("sum(fsum)", "x_sum", 2) + " from (select region_id, " + " + ".join(f"cast(cast({c} as real) as double)" for c in PANEL_FEATURES)
          + " as fsum, row_number() over (partition by region_id order by week_idx desc) as rn from m51_test) where rn <= 13 group by region_id", 2)
def _(spark, sf):
    last = windows.last_windows(windows.refine(src.panels(spark, sf, "v51")[1], False), PANEL_FEATURES)
    return last.select("region_id", F.aggregate(F.slice("x", 1, 13 * NF), F.lit(0.0), lambda a, v: a + v.cast("double")).alias("x_sum"))


@register("t5_folds", "select fold, split, region_id, start, tgt_start, tgt_end from t_folds")
def _(spark, sf):
    return src.samples(spark, sf).folded.select("fold", "split", "region_id", "start", "tgt_start", "tgt_end")


@register("t5_fold_bounds", "select fold, train_end, val_start, val_end from t_bounds")
def _(spark, sf):
    return windows.fold_bounds(src.samples(spark, sf).weekly)


def _scores(spark, sf):
    s = src.samples(spark, sf)
    return windows.fold_training_scores(s.weekly, s.folded)


@register("t6_fold_scores", "select fold, region_id, pos, " + q("score") + " from t_scores")
def _(spark, sf):
    return _scores(spark, sf)


@register("t7_target_encoding", f"select fold, region_id, {qs(['region_mean_score', 'region_zero_prob'], 6)} from t_encoding", 6)
def _(spark, sf):
    return encoding.fit_encoding(_scores(spark, sf))


@register("t7_fallback", "select fold, " + q("region_mean_score", "mean_score", 6) + ", " + q("region_zero_prob", "zero_prob", 6) + " from t_fallback", 6)
def _(spark, sf):
    out = encoding.encoding_fallback(encoding.fit_encoding(_scores(spark, sf)))
    return out.select("fold", F.col("_region_mean_score").alias("mean_score"), F.col("_region_zero_prob").alias("zero_prob"))


@register("t8_attach_encoding", """select f.fold, f.region_id, f.start, """ + q("coalesce(e.region_mean_score, b.region_mean_score)", "region_mean_score", 6) + ", "
          + q("coalesce(e.region_zero_prob, b.region_zero_prob)", "region_zero_prob", 6) + """ from t_folds f
join (select fold, avg(region_mean_score) as region_mean_score, avg(region_zero_prob) as region_zero_prob from t_encoding where region_id % 3 <> 0 group by fold) b on b.fold = f.fold
left join t_encoding e on e.fold = f.fold and e.region_id = f.region_id and e.region_id % 3 <> 0""", 6)
def _(spark, sf):
    seen = encoding.fit_encoding(_scores(spark, sf)).filter(F.col("region_id") % 3 != 0)  # the others fall back
    folded = src.samples(spark, sf).folded.select("fold", "region_id", "start")
    return encoding.attach_encoding(folded, seen, row="start").select("fold", "region_id", "start", "region_mean_score", "region_zero_prob")


@register("t8_test_encoding", f"select e.fold, t.region_id, {qs(['region_mean_score', 'region_zero_prob'], 6)} from (select distinct region_id from m51_test) t join t_encoding e using (region_id)", 6)
def _(spark, sf):
    return src.samples(spark, sf).test.select("fold", "region_id", "region_mean_score", "region_zero_prob")


@register("t9_all_window_digests", f"select {', '.join(DIGEST)}, {qs(YS + ['x_sum', 'd_sum', 'x_first', 'x_last'], 2)} from t_windows", 2)
def _(spark, sf):
    """Every window with its sums and targets, from the stored weeks and without folds."""
    return _window_digest(windows.sliding_windows(src.samples(spark, sf).weekly, PANEL_FEATURES))


WIDE_ROWS = ("select w.fold || '|' || w.region_id || '|' || w.start as k, w.start % 97 as o, r.pos - w.start + 1 as w, " + ", ".join(f"r.{c}" for c in PANEL_FEATURES)
             + ", cast(e.region_mean_score as real) as region_mean_score, cast(e.region_zero_prob as real) as region_zero_prob"
             + " from t_folds w join t_rows r on r.region_id = w.region_id and r.pos between w.start and w.start + 12 join t_encoding e on e.fold = w.fold and e.region_id = w.region_id where w.split = 'val'")


@register("t1_wide_sample", _elements_sql(WIDE_ROWS, "k", "o", [*PANEL_FEATURES, "region_mean_score", "region_zero_prob"]), 2)
def _(spark, sf):
    """The 448 places of the validation windows, features and encodings in order, by name."""
    val = src.samples(spark, sf).folded.filter("split = 'val'")
    return _elements(encoding.flat_with_encoding(val, NF), F.col("start") % 97, [*PANEL_FEATURES, "region_mean_score", "region_zero_prob"])


@register("t9_all_windows", "select region_id, count(*) as windows, max(start) as last_start from t_windows group by region_id")
def _(spark, sf):
    weekly = src.samples(spark, sf).weekly
    return windows.sliding_windows(weekly, PANEL_FEATURES).groupBy("region_id").agg(
        F.count(F.lit(1)).alias("windows"), F.max("start").alias("last_start"))


# --- model --------------------------------------------------------------------------------------------------------------
@register("m1_labels", "select fold, region_id, start, horizon, cast(y > 0 as bigint) as occurs from (" + " union all ".join(
    f"select fold, region_id, start, cast({h} as bigint) as horizon, y{h} as y from t_folds" for h in range(1, 6)) + ")")
def _(spark, sf):
    long_form = encoding.horizons(src.samples(spark, sf).folded.select("fold", "region_id", "start", "y"))
    return long_form.select("fold", "region_id", "start", "horizon", "occurs")


#: A fold of the model queries learns from all of its labelled windows.
LABELLED = None


def _trained(spark, sf):
    return src.stored(spark, sf, "trained", lambda: modelling.train(
        src.samples(spark, sf), hurdle.HurdleSettings(most_rows=LABELLED), model_folder=_folder(spark, sf, "models")))


@register("m2_m3_hurdle_out_of_fold")
def _(spark, sf):
    return _trained(spark, sf).out_of_fold


VAL_ROWS = " union all ".join(f"select fold, region_id, cast({h} as bigint) as horizon, y{h} as y from t_folds where split = 'val'" for h in range(1, 6))


@register("m2_m3_out_of_fold_rows", "select fold, region_id, horizon, " + q("cast(y as double)", "y_true") + f", true as severity_is_number, true as prob_is_share, true as gated from ({VAL_ROWS})")
def _(spark, sf):
    out = _trained(spark, sf).out_of_fold
    gate = F.when(F.col("prob_b") < 0.5, 0.0).otherwise(F.col("pred_a"))
    return out.select("fold", "region_id", "horizon", "y_true", (F.col("pred_a").isNotNull() & ~F.isnan("pred_a")).alias("severity_is_number"),
                      F.col("prob_b").between(0, 1).alias("prob_is_share"), (F.col("pred") == gate).alias("gated"))


@register("m4_hurdle_predictions")
def _(spark, sf):
    return _trained(spark, sf).predictions


@register("m4_prediction_rows", "select fold, region_id, horizon, true as severity_is_number, true as prob_is_share from (select distinct region_id from m51_test), (select cast(range as bigint) as fold from range(0, 4)), (select cast(range as bigint) as horizon from range(1, 6))")
def _(spark, sf):
    return _trained(spark, sf).predictions.select(
        "fold", "region_id", "horizon", (F.col("pred_a").isNotNull() & ~F.isnan("pred_a")).alias("severity_is_number"),
        F.col("prob_b").between(0, 1).alias("prob_is_share"))


@register("s7_reload_models", "select fold, horizon, (select count(distinct region_id) from m51_test) as regions, cast(0 as bigint) as different from (select cast(range as bigint) as fold from range(0, 4)), (select cast(range as bigint) as horizon from range(1, 6))")
def _(spark, sf):
    """Predictions of all reloaded models against those made before they were stored."""
    made, samples = _trained(spark, sf).predictions, src.samples(spark, sf)
    again = hurdle.predict_nodes(hurdle.load_nodes(spark, _folder(spark, sf, "models")), samples.test, 5)
    again = again.withColumnsRenamed({"pred_a": "a", "prob_b": "b"})
    both = made.join(again, ["fold", "region_id", "horizon"])
    return both.groupBy("fold", "horizon").agg(
        F.count(F.lit(1)).alias("regions"), F.count(F.when((F.col("a") != F.col("pred_a")) | (F.col("b") != F.col("prob_b")), 1)).alias("different"))


MODELS = "(select cast(range as bigint) as fold from range(0, 4)), (select unnest(['severity', 'occurrence']) as part), (select cast(range as bigint) as horizon from range(1, 6))"


@register("s7_model_nodes", f"select concat(part, '_fold', fold, '_h', horizon) as model, true as leaves_fit, cast(0 as bigint) as broken, true as one_start, true as splits_known from {MODELS}")
def _(spark, sf):
    """Trees of all stored models: every inner node has two children with its rows, one starting leaf, known features."""
    _trained(spark, sf)
    nodes = hurdle.named_nodes(hurdle.load_nodes(spark, _folder(spark, sf, "models")))
    more = nodes.groupBy("model").agg(
        (F.count(F.when(F.col("tree") == 0, 1)) == 1).alias("one_start"),
        F.bool_and(F.col("feature").isNull() | F.col("feature").between(0, 421) & F.col("threshold").isNotNull()).alias("splits_known"))
    return hurdle.tree_checks(nodes).join(more, "model").select(
        "model", (F.col("nodes") == 2 * F.col("leaves") - F.col("trees")).alias("leaves_fit"), "broken", "one_start", "splits_known")


MEDIANS = " union all ".join(
    f"select fold, {h} as horizon, median(y{h}) as m, avg((y{h} > 0)::double) as s from t_folds where split = 'train' group by fold" for h in range(1, 6))


@register("m4_skill", "select fold, horizon, regions, " + q("zero_error") + ", " + q("median_error") + ", true as no_worse_than_start from (select fold, horizon, count(*) as regions, avg(abs(y)) as zero_error, avg(abs(y - m)) as median_error from "
          f"({VAL_ROWS}) v join ({MEDIANS}) t using (fold, horizon) group by fold, horizon)")
def _(spark, sf):
    """Errors of two constant forecasts by fold and horizon, and that the severity model is no worse than the constant it starts from.

    These are the rows on which the rounds were chosen.
    """
    folded = src.samples(spark, sf).folded
    long_form = encoding.horizons(folded.filter("split = 'train'").select("fold", "region_id", "start", "y"))
    constant = long_form.groupBy("fold", "horizon").agg(F.median("y_true").alias("m"))
    held = _trained(spark, sf).out_of_fold
    start = hurdle.load_nodes(spark, _folder(spark, sf, "models")).filter("tree = 0 and part = 'severity'").select(
        "fold", "horizon", F.col("prediction").alias("start"))
    errors = held.join(constant, ["fold", "horizon"]).join(start, ["fold", "horizon"]).groupBy("fold", "horizon").agg(
        F.count(F.lit(1)).alias("regions"), F.avg(F.abs("y_true")).alias("zero"), F.avg(F.abs(F.col("y_true") - F.col("m"))).alias("middle"),
        F.avg(F.abs(F.col("y_true") - F.col("start"))).alias("start"), F.avg(F.abs(F.col("y_true") - F.col("pred_a"))).alias("severity"))
    return errors.select("fold", "horizon", "regions", F.col("zero").alias("zero_error"), F.col("middle").alias("median_error"),
                         (F.col("severity") <= F.col("start") + 1e-9).alias("no_worse_than_start"))


@register("m5_gate_out_of_fold", "select region_id, fold, horizon, " + q("pred") + " from gated")
def _(spark, sf):
    return _gated(spark, sf).select("region_id", "fold", "horizon", "pred")


def _gated(spark, sf):
    return ens.gate_out_of_fold(panel.prediction_fixture(spark, sf))


ERRS = "select fold, horizon, avg(abs(pred - y_true)) as mae from gated group by fold, horizon"


@register("m6_horizon_mae", f"select fold, horizon, {q('mae', None, 6)} from ({ERRS})", 6)
def _(spark, sf):
    return ens.horizon_errors(_gated(spark, sf))


@register("m6_cv_mae", f"select {q('avg(mae)', 'cv_mae', 6)}, {q('stddev_pop(mae)', 'cv_sd', 6)} from (select fold, avg(mae) as mae from ({ERRS}) group by fold)", 6)
def _(spark, sf):
    return ens.overall_error(ens.fold_errors(ens.horizon_errors(_gated(spark, sf))))


def _bin_case(c, bins):
    return " ".join(f"when {c} = {hi} then '{n}'" if lo is None else f"when {c} > {lo}" + (f" and {c} <= {hi}" if hi is not None else "") + f" then '{n}'" for n, lo, hi in bins)


@register("m7_binned_error", "select f.range as fold, l.bin, count(g.pred) as n, " + ", ".join([q("avg(g.y_true)", "avg_true", 6), q("avg(g.pred)", "avg_pred", 6), q("avg(abs(g.pred - g.y_true))", "mae", 6)])
          + " from range(0,4) f cross join (select unnest([" + ", ".join(f"'{n}'" for n, _, _ in SEVERITY_BINS) + "]) as bin) l left join (select *, case "
          + _bin_case("y_true", SEVERITY_BINS) + " end as bin from gated) g on g.fold = f.range and g.bin = l.bin group by f.range, l.bin", 6)
def _(spark, sf):
    return ens.binned_errors(_gated(spark, sf))


@register("m8_ranges", "select fold, " + ", ".join(q(f"{f}({c})", f"{n}_{f}") for c, n in (("prob_b", "prob"), ("pred_a", "pred")) for f in ("min", "max")) + " from preds group by fold")
def _(spark, sf):
    return ens.prediction_ranges(panel.prediction_fixture(spark, sf))


@register("m8_across_folds", "select region_id, fold, horizon, " + qs(["pred_a", "prob_b"]) + " from preds where horizon = 1 and region_id = (select min(region_id) from preds)")
def _(spark, sf):
    return ens.across_folds(panel.prediction_fixture(spark, sf))


@register("m9_threshold_sweep", "select t as threshold, " + q("avg(abs(case when prob_b < t then 0.0 else pred_a end - y_true))", "mae", 6)
          + " from preds, (select unnest([0.30, 0.45, 0.605]::double[]) as t) group by t", 6)
def _(spark, sf):
    return modelling.best_threshold(panel.prediction_fixture(spark, sf), [0.30, 0.45, 0.605])


# --- ensemble ---------------------------------------------------------------------------------------------------------------
def _merged(spark, sf):
    return ens.ensemble(panel.prediction_fixture(spark, sf))


@register("e1_ensemble", f"select region_id, horizon, {qs(['severity', 'prob'], 6)} from merged", 6)
def _(spark, sf):
    return _merged(spark, sf)


for _name, _mode, _t, _round, _grp in (
    ("e2_gate_hard", "HARD", 0.5, False, "hard50_raw"), ("e2_gate_hard62", "HARD", 0.62, False, "hard62_raw"), ("e2_gate_soft", "SOFT", 0.5, False, "soft_raw"),
):
    _expr = {"hard50_raw": "case when prob < 0.5 then 0.0 else severity end", "hard62_raw": "case when prob < 0.62 then 0.0 else severity end", "soft_raw": "severity*prob"}[_grp]

    def _run(spark, sf, mode=_mode, t=_t, rounding=_round):
        return ens.forecast(_merged(spark, sf), mode, t, rounding)
    register(_name, "select region_id, horizon, " + q(f"least(greatest({_expr}, 0.0), 5.0)", "pred", 6) + " from merged", 6)(_run)


@register("e3_wide_forecast", "select region_id, " + ", ".join(q(f"max(case when horizon = {h} then round_even(least(greatest(severity*prob, 0.0), 5.0), 0) end)", f"pred_week{h}") for h in range(1, 6)) + " from merged group by region_id")
def _(spark, sf):
    return modelling.infer(panel.prediction_fixture(spark, sf), "SOFT")


@register("e4_forecast_summary", "select (select " + q("avg(severity)", "mean_severity", 6).rsplit(" as ", 1)[0] + " from merged) as mean_severity, (select " + q("avg(prob)", "mean_prob", 6).rsplit(" as ", 1)[0] + " from merged) as mean_prob, " + q("avg(value)", "mean_pred", 6) + ", " + q("avg(case when value = 0 then 1.0 else 0.0 end)", "zero_share", 6) + " from subs where grp = 'hard50'", 6)
def _(spark, sf):
    merged = stage(_merged(spark, sf), "merged")
    return ens.forecast_summary(merged, ens.forecast(merged))


# --- submissions ---------------------------------------------------------------------------------------------------------------
def _submissions(spark, sf):
    merged = stage(_merged(spark, sf), "merged")
    parts = []
    for name, mode, t in (("hard50", "HARD", 0.5), ("hard62", "HARD", 0.62), ("soft", "SOFT", 0.5)):
        for suffix, rounding in (("", True), ("_raw", False)):
            wide = ens.wide_forecast(ens.forecast(merged, mode, t, rounding))
            parts.append(dist.submission_values(wide, name + suffix))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return stage(out, "submissions")


@register("q1_percentiles", "select grp, " + ", ".join(q(f"quantile_cont(value, {p / 100})", f"p{p}", 6) for p in PERCENTS) + " from subs group by grp", 6)
def _(spark, sf):
    return dist.percentile_table(_submissions(spark, sf))


@register("q2_interval_shares", "select grp, " + ", ".join(
    q("avg(case when " + (f"value = {hi}" if lo is None else f"value > {lo} and value <= {hi}") + " then 1.0 else 0.0 end)", dist.share_name(n), 6)
    for n, lo, hi in SHARE_BINS) + " from subs group by grp", 6)
def _(spark, sf):
    return dist.share_table(_submissions(spark, sf))


def _density_sql(source, lo, hi, h, points):
    return f"""select grp, j, {q('max(x)', 'x', 6)}, {q('sum(k)', 'density', 6)} from (
select v.grp, g.range as j, lo + g.range*(hi-lo)/{float(points - 1)} as x, exp(-0.5*pow((lo + g.range*(hi-lo)/{float(points - 1)} - v.value)/h, 2))/(n*h*sqrt(2*pi())) as k
from ({source}) v join (select grp, cast(count(*) as double) as n, {lo} as lo, {hi} as hi, {h} as h from ({source}) group by grp) s using (grp), range(0,{points}) g) group by grp, j"""


@register("q3_density", _density_sql("select * from subs", "-0.2", "5.2", "0.5*stddev_samp(value)*pow(count(*), -0.2)", 200), 6)
def _(spark, sf):
    return dist.density(_submissions(spark, sf), 200, -0.2, 5.2)


# --- profiles --------------------------------------------------------------------------------------------------------------------
def _tr(spark, sf):
    return src.train_panel(spark, sf, "v54")


def _te(spark, sf):
    return src.panels(spark, sf, "v54")[1]


RAWF = ["prec", "tmp", "humidity", "wind", "pet_raw", "vpd_raw"]


@register("x1_severity_shift", "select feature, safe_days, ext_days, " + qs(["safe_mean", "ext_mean", "edge"]) + ", " + q("(ext_mean - safe_mean)/(abs(safe_mean) + 1e-5)*100", "shift_pct") + ", coalesce(abs((ext_mean - safe_mean)/(abs(safe_mean) + 1e-5)*100) > 40, false) as flag from ("
          + " union all ".join(f"select '{c}' as feature, count(*) filter (where score = 0) as safe_days, count(*) filter (where score > 3.5) as ext_days, avg(case when score = 0 then {c} end) as safe_mean, avg(case when score > 3.5 then {c} end) as ext_mean, quantile_cont({c}, {0.1 if c in ('prec', 'humidity') else 0.9}) filter (where score > 3.5) as edge from raw_train" for c in RAWF) + ")")
def _(spark, sf):
    return explore.severity_shift(src.train(spark, sf))


def _metric(name, agg):
    return f"select '{name}' as metric, (select {agg} from raw_train) as train, (select {agg} from raw_test) as test"


@register("x2_cohort_metrics", f"select metric, {qs(['train', 'test'])}, test > train*1.15 as flag from (" + " union all ".join(_metric(n, a) for n, a in (
    ("avg_tmp", "avg(tmp)"), ("p99_tmp", "quantile_cont(tmp, 0.99)"), ("avg_humidity", "avg(humidity)"), ("avg_prec", "avg(prec)"),
    ("avg_vpd", "avg(vpd_raw)"), ("p99_vpd", "quantile_cont(vpd_raw, 0.99)"))) + ")")
def _(spark, sf):
    # The other days of a run have no measures, so they count nowhere.
    return explore.cohort_metrics(src.train_runs(spark, sf), src.test(spark, sf))


@register("x3_hot_and_dry", f"select {qs(['hot_limit', 'train_share', 'test_share'], 6)}, test_share > 2*train_share as alarm from (select hot_limit, "
          "(select avg(case when tmp > hot_limit and prec < 1 then 1.0 else 0.0 end) from p_train) as train_share, (select avg(case when tmp > hot_limit and prec < 1 then 1.0 else 0.0 end) from p_test) as test_share "
          "from (select avg(tmp) as hot_limit from p_train where score > 3.5))", 6)
def _(spark, sf):
    return explore.hot_and_dry(src.train(spark, sf), src.test(spark, sf))


@register("x4_panel_audit", " union all ".join(
    f"select '{c}' as cohort, cast(sum(n) as bigint) as rows, count(*) as regions, min(n) as weeks_min, max(n) as weeks_max, {q('avg(n)', 'weeks_mean')}, cast({36 if c == 'test' else 37} as bigint) as present, cast(37 as bigint) as expected, '{'tmp_max' if c == 'test' else ''}' as missing from (select region_id, count(*) as n from e_{c} group by region_id)" for c in ("train", "test")))
def _(spark, sf):
    return explore.panel_audit(_tr(spark, sf), _te(spark, sf).drop("tmp_max"))


@register("x4_audit_nulls", each("select '@' as \"column\", count(*) - count(@) as nulls from e_train", PROFILE_FEATURES + ["score"], " union all "))
def _(spark, sf):
    return explore.audit_nulls(_tr(spark, sf))


@register("x5_score_brackets", "select l.bracket, " + ", ".join([q("mean", None, 6), q("sd", None, 6), q("zero_share", None, 6)]) + ", coalesce(c, 0) as count, " + q("coalesce(c, 0)/n", "share", 6)
          + " from (select unnest([" + ", ".join(f"'{n}'" for n, _, _ in SEVERITY_BINS) + "]) as bracket) l cross join (select avg(score) as mean, stddev_pop(score) as sd, avg(case when score = 0 then 1.0 else 0.0 end) as zero_share, count(*) as n from e_train where score is not null) "
          + "left join (select case " + _bin_case("score", SEVERITY_BINS) + " end as bracket, count(*) as c from e_train group by 1) b on b.bracket = l.bracket", 6)
def _(spark, sf):
    return explore.score_brackets(_tr(spark, sf))


@register("x6_score_histogram", 'select g.range as bin, count(e.score) as "count", ' + q("-0.25 + 0.5*g.range", '"left"') + " from range(0,11) g left join (select score from e_train where score between -0.25 and 5.25) e on least(floor((e.score + 0.25)/0.5), 10) = g.range group by g.range")
def _(spark, sf):
    return dist.edge_histogram(_tr(spark, sf), "score", -0.25, 0.5, 11)


@register("x6_integer_counts", 'select g.range as "at", count(e.score) as "count", ' + q("count(e.score)/(select count(score) from e_train)", "share", 6) + " from range(0,6) g left join e_train e on e.score >= g.range - 0.25 and e.score < g.range + 0.25 group by g.range", 6)
def _(spark, sf):
    return dist.around_integers(_tr(spark, sf), "score")


@register("x7_empirical_cdf", "select grp, " + q("value", None, 6) + ", " + q("c/n", "cdf", 6) + " from (select distinct grp, value, count(*) over (partition by grp order by value) as c, count(*) over (partition by grp) as n from (" + long("e_train", ["score", "surf_pre", "surf_pre_week_max"]) + "))", 6)
def _(spark, sf):
    return dist.empirical_cdf(ranks.long_form(_tr(spark, sf), ["score", "surf_pre", "surf_pre_week_max"]))


@register("x8_feature_shift", "select feature, " + qs(["tr_mean", "te_mean", "tr_p99", "te_p99", "ratio"]) + ", " + q("pct", "p99_pct") + ", cast(case when pct > 15 then 2 when pct > 8 then 1 else 0 end as bigint) as danger from (select *, te_mean/(round(tr_mean, 12) + 1e-9) as ratio, (te_p99 - tr_p99)/(abs(tr_p99) + 1e-9)*100 as pct from ("
          + " union all ".join(f"select '{c}' as feature, (select avg({c}) from e_train) as tr_mean, (select avg({c}) from e_test) as te_mean, (select quantile_cont(cast({c} as double), 0.99) from e_train) as tr_p99, (select quantile_cont(cast({c} as double), 0.99) from e_test) as te_p99" for c in COMPARED_FEATURES) + "))")
def _(spark, sf):
    return explore.feature_shift(_tr(spark, sf), _te(spark, sf))


@register("x9_feature_density", " union all ".join("select '" + c + "' as cohort, * from (" + _density_sql(long(f"e_{c}", DENSITY_FEATURES), "min(value) - (max(value)-min(value))/2.0", "max(value) + (max(value)-min(value))/2.0", "0.3*stddev_samp(value)", 1000) + ")" for c in ("train", "test")), 6)
def _(spark, sf):
    a, b = (dist.density(ranks.long_form(df, DENSITY_FEATURES), 1000, factor=0.3).withColumn("cohort", F.lit(n))
            for n, df in (("train", _tr(spark, sf)), ("test", _te(spark, sf))))
    return a.unionByName(b)


def _level(name, lo, hi):
    return f"score = {hi}" if lo is None else f"score > {lo}" + (f" and score <= {hi}" if hi is not None else "")


LEVEL_MEANS = [f"{n}_mean" for n, _, _ in LEVELS]


@register("x10_level_profile", f"select feature, {qs(LEVEL_MEANS)}, {q('times', 'multiplier')}, cast(case when times > 2 then 2 when times > 1.3 then 1 else 0 end as bigint) as flag from (select *, ext_mean/(abs(safe_mean) + 1e-6) as times from ("
          + " union all ".join(f"select '{c}' as feature, " + ", ".join(f"avg(case when {_level(*lv)} then {c} end) as {lv[0]}_mean" for lv in LEVELS) + " from e_train" for c in DROUGHT_FEATURES) + "))")
def _(spark, sf):
    return explore.level_profile(_tr(spark, sf))


@register("x10_level_counts", " union all ".join(f"select '{lv[0]}' as level, count(*) filter (where {_level(*lv)}) as count, {q(f'count(*) filter (where {_level(*lv)})/count(score)', 'share', 6)} from e_train" for lv in LEVELS), 6)
def _(spark, sf):
    return explore.level_counts(_tr(spark, sf))


def _even(df, cols):
    """Values rounded as in the SQL: equal weeks must tie in both engines, whatever the summation order."""
    return df.withColumns({c: F.round(F.col(c).cast("double") + 2.3e-9, 6) for c in cols})


def _even_sql(cols):
    return "select region_id, week_idx, " + ", ".join(f"round(cast({c} as double) + 2.3e-9, 6) as {c}" for c in cols) + " from e_train where score is not null"


def _ranked_sql(cols):
    return "select region_id, week_idx, " + ", ".join(average_rank(c) for c in cols) + f" from ({_even_sql(cols)})"


def _matrix_sql(source, cols):
    structs = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'r': corr({a}, {b})}}" for a in cols for b in cols)
    return f"select p.a, p.b, {q('p.r', 'r', 6)} from (select unnest([{structs}]) as p from ({source}))"


CORR = PROFILE_FEATURES + ["score"]


@register("x11_spearman", "select p.feature, " + q("p.r", "r", 6) + " from (select unnest([" + ", ".join(f"{{'feature': '{c}', 'r': corr({c}, score)}}" for c in DROUGHT_FEATURES) + "]) as p from (" + _ranked_sql(DROUGHT_FEATURES + ["score"]) + "))", 6)
def _(spark, sf):
    return explore.spearman_with_score(_even(_tr(spark, sf), DROUGHT_FEATURES)).select("feature", "r")


def _log10_p_sql(r, n):
    z = f"((8*({n}-2)+1.0)/(8*({n}-2)+3.0)*sqrt(({n}-2)*ln(1 + {r}*{r}/(1-{r}*{r})))/sqrt(2.0))"
    poly = "0.0"
    for c in reversed(explore.ERFC):
        poly = f"({poly}*t + ({c}))"
    return f"(select (ln(t) - x*x + {poly})/ln(10.0) from (select x, 2/(2 + x) as t from (select {z} as x)))"


@register("x11_spearman_significance", "select feature, n, " + qs(["r", "log10_p"], 3) + ", case when log10_p < -3 then '***' when log10_p < -2 then '**' when log10_p < log10(0.05) then '*' else '' end as stars from (select *, "
          + _log10_p_sql("r", "n") + " as log10_p from (select p.feature, p.r, n from (select count(*) as n, unnest([" + ", ".join(f"{{'feature': '{c}', 'r': corr({c}, score)}}" for c in DROUGHT_FEATURES) + "]) as p from (" + _ranked_sql(DROUGHT_FEATURES + ["score"]) + "))))", 3)
def _(spark, sf):
    return explore.spearman_with_score(_even(_tr(spark, sf), DROUGHT_FEATURES)).drop("p_value")


def _scored(spark, sf):
    return _tr(spark, sf).dropna(subset=["score"])


@register("x12_corr_matrix", _matrix_sql("select * from e_train where score is not null", CORR), 6)
def _(spark, sf):
    return explore.correlation_matrix(_scored(spark, sf), CORR)


def _spearman(spark, sf):
    return explore.spearman_matrix(_even(_scored(spark, sf), CORR), CORR, WEEK)


@register("x12_spearman_matrix", _matrix_sql(_ranked_sql(CORR), CORR), 6)
def _(spark, sf):
    return _spearman(spark, sf)


@register("x13_score_ranking_spearman", "select p.feature, " + q("p.r", "r", 6) + " from (select unnest([" + ", ".join(f"{{'feature': '{c}', 'r': corr({c}, score)}}" for c in PROFILE_FEATURES) + "]) as p from (" + _ranked_sql(CORR) + "))", 6)
def _(spark, sf):
    return explore.score_ranking(src.stored(spark, sf, "spearman", lambda: stage(_spearman(spark, sf), "spearman")))


@register("x13_score_ranking", "select p.feature, " + q("p.r", "r", 6) + " from (select unnest([" + ", ".join(f"{{'feature': '{c}', 'r': corr({c}, score)}}" for c in PROFILE_FEATURES) + "]) as p from e_train where score is not null)", 6)
def _(spark, sf):
    return explore.score_ranking(explore.correlation_matrix(_scored(spark, sf), CORR))


@register("x14_region_series", f"select region_id, week_idx, day_ordinal, {qs(['tmp', 'humidity', 'prec', 'wind', 'score'])} from e_train where region_id in (select region_id from (select distinct region_id from e_train) order by (region_id*7919 + 42) % 10007, region_id limit 5)")
def _(spark, sf):
    return explore.region_series(_tr(spark, sf), 5, (F.col("region_id") * 7919 + 42) % 10007)


def _box_sql(source):
    return f"""select b.grp, {qs(['q1', 'median', 'q3'])}, {q('min(value) filter (where inside)', 'whisker_low')}, {q('max(value) filter (where inside)', 'whisker_high')}, count(*) filter (where not inside) as outliers, count(*) as n
from (select v.grp, v.value, q1, median, q3, v.value >= q1 - 1.5*(q3-q1) and v.value <= q3 + 1.5*(q3-q1) as inside from ({source}) v
join (select grp, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from ({source}) group by grp) using (grp)) b group by b.grp, q1, median, q3"""


@register("x15_box_stats", _box_sql(long("(" + _even_sql(BOX_FEATURES).replace(" where score is not null", "") + ")", BOX_FEATURES)))
def _(spark, sf):
    # Rounded: a value on the edge of a whisker must lie on the same side in both engines.
    return dist.box_stats(ranks.long_form(_even(_tr(spark, sf), BOX_FEATURES), BOX_FEATURES))


@register("x16_cyclic_audit", "select " + ", ".join([q("min(week_sin)", "sin_min", 6), q("max(week_sin)", "sin_max", 6), q("min(week_cos)", "cos_min", 6), q("max(week_cos)", "cos_max", 6), q("avg(sqrt(week_sin*week_sin + week_cos*week_cos))", "mean_radius", 6)]) + " from e_train", 6)
def _(spark, sf):
    return explore.cyclic_audit(_tr(spark, sf))


def _hist_sql(c, bins, source):
    return f"""select g.range as bin, count(b.at) as "count" from range(0,{bins}) g left join (
select least(floor(({c} - lo)/(hi - lo)*{bins}), {bins - 1}) as at from {source}, (select case when max({c}) = min({c}) then min({c}) - 0.5 else min({c}) end as lo, case when max({c}) = min({c}) then max({c}) + 0.5 else max({c}) end as hi from {source})) b on b.at = g.range group by g.range"""


for _c in ("week_sin", "week_cos"):
    register(f"x16_histogram_{_c}", _hist_sql(_c, 60, "e_train"))(lambda spark, sf, c=_c: dist.histogram(_tr(spark, sf), c, 60))


@register("x17_weeks_histogram", " union all ".join(f"select '{c}' as cohort, * from ({_hist_sql('n', bins, f'(select count(*) as n from e_{c} group by region_id)')})" for c, bins in (("train", 30), ("test", 20))))
def _(spark, sf):
    return explore.weeks_histogram(_tr(spark, sf), _te(spark, sf))


GAPS = "select a.region_id, cast(round_even((lo - hi)/7.0, 0) as bigint) as gap from (select region_id, max(day_ordinal) as hi from e_train group by region_id) a join (select region_id, min(day_ordinal) as lo from e_test group by region_id) b using (region_id)"


@register("x18_region_gaps", GAPS)
def _(spark, sf):
    return explore.region_gaps(_tr(spark, sf), _te(spark, sf))


@register("x18_deployment_gap", f"select min(gap) as gap_min, max(gap) as gap_max, {q('avg(gap)', 'gap_mean', 6)}, cast(trunc(median(gap)) as bigint) as gap_median from ({GAPS})", 6)
def _(spark, sf):
    return explore.deployment_gap(_tr(spark, sf), _te(spark, sf))


@register("x19_available_windows", f"select region_id, cast(greatest(count(*) - 13 - (select trunc(median(gap)) from ({GAPS})) - 5, 0) as bigint) as windows from e_train group by region_id")
def _(spark, sf):
    gap = explore.deployment_gap(_tr(spark, sf), _te(spark, sf)).select("gap_median").scalar()
    return explore.available_windows(_tr(spark, sf), gap)


@register("x20_cluster_profile", f"select cluster_id, count(*) as regions, {', '.join(q(f'round(avg({c}) + 2.3e-9, 4)', c) for c in CLUSTER_FEATURES_V54 + ['score_mean', 'score_zero_prob'])} from stats54 left join (select region_id, avg(score) as score_mean, avg(case when score = 0 then 1.0 else 0.0 end) as score_zero_prob from e_train where score is not null group by region_id) using (region_id) group by cluster_id")
def _(spark, sf):
    return explore.cluster_profile(stage(_stats54(spark, sf), "stats"), _tr(spark, sf), CLUSTER_FEATURES_V54)


@register("x21_cluster_spread", f"select cluster_id, {', '.join(q(f'round(stddev_samp({c}) + 2.3e-9, 4)', c) for c in CLUSTER_FEATURES_V54)} from stats54 group by cluster_id")
def _(spark, sf):
    return explore.cluster_spread(_stats54(spark, sf), CLUSTER_FEATURES_V54)


@register("x21_cluster_boxes", "select cast(split_part(grp, '|', 1) as bigint) as cluster_id, split_part(grp, '|', 2) as feature, * exclude (grp) from (" + _box_sql(
    " union all ".join(f"select concat(cast(cluster_id as varchar), '|{c}') as grp, cast({c} as double) as value from stats54" for c in CLUSTER_FEATURES_V54)) + ")")
def _(spark, sf):
    return explore.cluster_boxes(stage(_stats54(spark, sf), "stats"), CLUSTER_FEATURES_V54)


@register("x22_cluster_pairs", f"select cluster_id, {qs(['tmp_mean', 'prec_mean', 'humidity_mean', 'wind_mean'])} from stats54")
def _(spark, sf):
    return explore.cluster_pairs(_stats54(spark, sf))


def _adversarial(spark, sf):
    """All numeric columns that both cohorts have."""
    def build():
        train, test = _tr(spark, sf), _te(spark, sf)
        numeric = {f.name for f in train.schema if isinstance(f.dataType, T.NumericType)}
        cols = [c for c in test.columns if c in numeric and c not in (*WEEK, "day_ordinal", "cluster_id")]
        return (*hurdle.adversarial(train, test, cols), cols)
    return src.stored(spark, sf, "adversarial", build)


@register("x23_adversarial_auc")
def _(spark, sf):
    return hurdle.adversarial_summary(_adversarial(spark, sf)[0])


@register("x23_auc_checks", "select true as above_chance, true as band_fits, (select count(*) from e_train) as train_rows, (select count(*) from e_test) as test_rows")
def _(spark, sf):
    """The AUC of the fitted models against bounds; the AUC of given scores is compared by value below."""
    scored = _adversarial(spark, sf)[0]
    rows = scored.agg(F.count(F.when(F.col("label") == 0, 1)).alias("a"), F.count(F.when(F.col("label") == 1, 1)).alias("b")).agg(F.first(F.struct("a", "b"))).scalar()
    auc, shift = F.col("auc"), F.col("shift")
    return hurdle.adversarial_summary(scored).select(
        ((auc > 0.5) & (auc <= 1)).alias("above_chance"),
        (shift == F.when(auc < 0.55, "low").when(auc < 0.65, "moderate").otherwise("high")).alias("band_fits"),
        rows["a"].alias("train_rows"), rows["b"].alias("test_rows"))


@register("x23_summary_of_scores", "select *, case when auc < 0.55 then 'low' when auc < 0.65 then 'moderate' else 'high' end as shift from (select " + q("(sum(case when y = 1 then r end) - sum(y)*(sum(y)+1)/2.0)/(sum(y)*(count(*)-sum(y)))", "auc", 6)
          + " from (select y, rank() over (order by pred_a) + (count(*) over (partition by pred_a) - 1)/2.0 as r from (select pred_a, cast(region_id % 2 as double) as y from preds)))", 6)
def _(spark, sf):
    return hurdle.adversarial_summary(panel.prediction_fixture(spark, sf).select((F.col("region_id") % 2).cast("int").alias("label"), F.col("pred_a").alias("score")))


@register("x23_scored_rows", "select region_id, week_idx, cast(0 as bigint) as label, true as in_range from e_train union all select region_id, week_idx, 1, true from e_test")
def _(spark, sf):
    return _adversarial(spark, sf)[0].select(*WEEK, F.col("label").cast("long").alias("label"), F.col("score").between(0, 1).alias("in_range"))


@register("x24_top_importances")
def _(spark, sf):
    _, nodes, cols = _adversarial(spark, sf)
    return hurdle.top_importances(hurdle.split_counts(nodes, cols))


ADVERSARIAL_COLUMNS = "(select count(*) from (describe e_test) where column_type in ('DOUBLE', 'FLOAT', 'BIGINT', 'INTEGER', 'TINYINT') and column_name not in ('region_id', 'week_idx', 'day_ordinal', 'cluster_id'))"


@register("x24_importance_checks", f"select {ADVERSARIAL_COLUMNS} as features, true as counts_are_splits, true as gain_where_split, true as top_is_sorted, cast(least(20, {ADVERSARIAL_COLUMNS}) as bigint) as listed")
def _(spark, sf):
    """Importances against the node table: three times the mean counts are all inner nodes."""
    _, nodes, cols = _adversarial(spark, sf)
    counts = hurdle.split_counts(nodes, cols)
    inner = nodes.filter("feature is not null").agg(F.count(F.lit(1)).cast("double")).scalar()
    top = hurdle.top_importances(counts).withColumn("before", F.lag("importance").over(Window.orderBy(F.desc("importance"), "feature")))
    whole = counts.agg(
        F.count(F.lit(1)).alias("features"), (F.abs(F.sum("importance") * 3 - inner) < 1e-6).alias("counts_are_splits"),
        F.bool_and((F.col("importance") > 0) == (F.col("gain") > 0)).alias("gain_where_split"))
    order = top.agg(F.bool_and(F.coalesce(F.col("before") >= F.col("importance"), F.lit(True))).alias("top_is_sorted"), F.count(F.lit(1)).alias("listed"))
    return whole.withColumn("o", order.agg(F.first(F.struct("top_is_sorted", "listed"))).scalar()).select(
        "features", "counts_are_splits", "gain_where_split", "o.top_is_sorted", "o.listed")


@register("x24_top_of_weights", "select feature, " + q("importance", None, 6) + " from (select p.feature, p.importance from (select unnest([" + ", ".join(f"{{'feature': '{c}', 'importance': avg({c})}}" for c in PROFILE_FEATURES) + "]) as p from e_train)) order by importance desc, feature limit 20", 6)
def _(spark, sf):
    """The same selection on plain column means."""
    means = _tr(spark, sf).agg(*[F.avg(c).alias(c) for c in PROFILE_FEATURES])
    return hurdle.top_importances(means.unpivot([], PROFILE_FEATURES, "feature", "importance"))


# --- ranks, folds, samples -----------------------------------------------------------------------------------------------------------
@register("q_rank", "select region_id, week_idx, " + qs(["prec", "tmp", "score"]) + " from (" + _ranked_sql(["prec", "tmp", "score"]) + ")")
def _(spark, sf):
    return explore.rank_columns(_even(_scored(spark, sf), ["prec", "tmp", "score"]), ["prec", "tmp", "score"], WEEK)


@register("q_quantiles", " union all ".join("select grp, cast(" + str(p) + " as double) as prob, " + q(f"quantile_cont(value, {p})", "quantile") + " from (" + long("p_train", ["tmp", "prec"]) + ") group by grp" for p in (0.0, 0.1, 0.5, 0.9, 1.0)))
def _(spark, sf):
    return ranks.quantiles(ranks.long_form(src.train(spark, sf), ["tmp", "prec"]), [0.0, 0.1, 0.5, 0.9, 1.0])


@register("q_auc", "select " + q("(sum(case when y = 1 then r end) - sum(y)*(sum(y)+1)/2.0)/(sum(y)*(count(*)-sum(y)))", "auc", 6) + " from (select y, rank() over (order by pred_a) + (count(*) over (partition by pred_a) - 1)/2.0 as r from (select pred_a, cast(y_true > 2 as double) as y from preds))", 6)
def _(spark, sf):
    return ranks.auc(panel.prediction_fixture(spark, sf).select((F.col("y_true") > 2).cast("int").alias("label"), F.col("pred_a").alias("score")))


@register("q_stratified_folds", "select region_id, week_idx, label, (row_number() over (partition by label order by h) - 1) % 3 as fold from (select region_id, week_idx, cast(score > 0 as bigint) as label, ((region_id*1009 + week_idx*9176) % 1000003)*1000000000 + region_id*1000 + week_idx as h from e_train where score is not null)")
def _(spark, sf):
    r, w = F.col("region_id"), F.col("week_idx")
    order = ((r * 1009 + w * 9176) % 1000003) * 1000000000 + r * 1000 + w
    df = _scored(spark, sf).select(*WEEK, (F.col("score") > 0).cast("long").alias("label"))
    return explore.stratified_folds(df, order, 3)


SAMPLE_ORDER = "(region_id*1009 + week_idx*9176) % 1000003"


@register("q_seeded_sample", f"select region_id, week_idx, {qs(['tmp', 'score'])} from e_train order by {SAMPLE_ORDER}, region_id, week_idx limit 2000")
def _(spark, sf):
    return explore.seeded_sample(_tr(spark, sf).select(*WEEK, "tmp", "score"), 2000, WEEK, order=F.expr(SAMPLE_ORDER))
