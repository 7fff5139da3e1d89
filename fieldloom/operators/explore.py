"""Profiles of the raw and the weekly panels: shifts, audits, correlations, structure."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    COMPARED_FEATURES, DROUGHT_FEATURES, HORIZON, LEVELS, PROFILE_FEATURES, SEVERITY_BINS, WINDOW,
)
from ..functions.scalars import in_bin, pet, vapour_deficit
from .distributions import _all_bins, box_stats, histogram
from .impute import null_counts, present
from . import rank_matrix
from .ranks import average_ranks, long_form, quantiles
from .regions import zero_share
from .splits import KEY, dense_position


def _rows(*structs: Column) -> Column:
    return F.inline(F.array(*structs))


def _wide_to_rows(wide: DataFrame, names: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn one row of columns ``<prefix><i>`` into one row per name."""
    return wide.select(_rows(*[
        F.struct(F.lit(n).alias("feature"), *[F.col(f"{p}{i}").alias(f) for f, p in fields.items()])
        for i, n in enumerate(names)]))


# --- raw data --------------------------------------------------------------------

def with_proxies(daily: DataFrame) -> DataFrame:
    return daily.withColumn("pet_raw", pet(F.col("tmp"))).withColumn(
        "vpd_raw", vapour_deficit(F.col("tmp"), F.col("humidity")))


def severity_shift(train: DataFrame) -> DataFrame:
    """Safe against extreme days: cohort sizes, means, the extreme edge and the relative shift."""
    df = with_proxies(train)
    feats = present(["prec", "tmp", "humidity", "wind", "pet_raw", "vpd_raw"], df)
    safe, ext = F.col("score") == 0, F.col("score") > 3.5
    wide = df.agg(
        F.count(F.when(safe, 1)).alias("safe_days"), F.count(F.when(ext, 1)).alias("ext_days"),
        *[F.avg(F.when(safe, F.col(c))).alias(f"s{i}") for i, c in enumerate(feats)],
        *[F.avg(F.when(ext, F.col(c))).alias(f"e{i}") for i, c in enumerate(feats)])
    means = wide.select("safe_days", "ext_days", _rows(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("safe_mean"), F.col(f"e{i}").alias("ext_mean"))
        for i, c in enumerate(feats)]))
    low_side = F.col("grp").isin("prec", "humidity")
    edges = quantiles(long_form(df.filter(ext), feats), [0.1, 0.9]).filter(
        F.when(low_side, F.col("prob") < 0.5).otherwise(F.col("prob") > 0.5))
    shift = (F.col("ext_mean") - F.col("safe_mean")) / (F.abs("safe_mean") + 1e-5) * 100
    return means.join(edges.select(F.col("grp").alias("feature"), F.col("quantile").alias("edge")), "feature", "left").select(
        "feature", "safe_mean", "ext_mean", "safe_days", "ext_days", "edge", shift.alias("shift_pct"),
        F.coalesce(F.abs(shift) > 40, F.lit(False)).alias("flag"))


def cohort_metrics(train: DataFrame, test: DataFrame) -> DataFrame:
    """Six climate metrics of both cohorts, flagged where test exceeds train by 15 %."""
    tables = []
    for name, df in (("train", train), ("test", test)):
        df = with_proxies(df)
        means = df.agg(*[F.avg(c).alias(c) for c in ("tmp", "humidity", "prec", "vpd_raw")]).select(_rows(*[
            F.struct(F.lit(m).alias("metric"), F.col(c).alias("v")) for m, c in
            (("avg_tmp", "tmp"), ("avg_humidity", "humidity"), ("avg_prec", "prec"), ("avg_vpd", "vpd_raw"))]))
        tops = quantiles(long_form(df, ["tmp", "vpd_raw"]), [0.99]).select(
            F.when(F.col("grp") == "tmp", "p99_tmp").otherwise("p99_vpd").alias("metric"), F.col("quantile").alias("v"))
        tables.append(means.unionByName(tops).withColumnRenamed("v", name))
    both = tables[0].join(F.broadcast(tables[1]), "metric")
    return both.withColumn("flag", F.coalesce(F.col("test") > F.col("train") * 1.15, F.lit(False)))


def hot_and_dry(train: DataFrame, test: DataFrame) -> DataFrame:
    """Share of days hotter than the mean extreme day and nearly without rain."""
    limit = train.agg(F.avg(F.when(F.col("score") > 3.5, F.col("tmp")))).scalar()
    hit = F.coalesce((F.col("tmp") > limit) & (F.col("prec") < 1.0), F.lit(False)).cast("double")
    other = test.agg(F.avg(hit)).scalar()
    out = train.agg(F.avg(hit).alias("train_share"))
    return out.select(limit.alias("hot_limit"), "train_share", other.alias("test_share")).withColumn(
        "alarm", F.col("test_share") > 2 * F.col("train_share"))


# --- weekly panel ------------------------------------------------------------------

def panel_audit(train: DataFrame, test: DataFrame, expected: list[str] = PROFILE_FEATURES) -> DataFrame:
    """Shape, feature coverage (with the names of missing ones) and weeks per region of both cohorts."""
    parts = []
    for name, df in (("train", train), ("test", test)):
        per = df.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
        parts.append(per.agg(
            F.sum("n").cast("long").alias("rows"), F.count(F.lit(1)).alias("regions"), F.min("n").alias("weeks_min"),
            F.max("n").alias("weeks_max"), F.avg("n").alias("weeks_mean")).select(
            F.lit(name).alias("cohort"), "*", F.lit(len(present(expected, df))).cast("long").alias("present"),
            F.lit(len(expected)).cast("long").alias("expected"),
            F.lit(",".join(c for c in expected if c not in df.columns)).alias("missing")))
    return parts[0].unionByName(parts[1])


def audit_nulls(train: DataFrame) -> DataFrame:
    """Missing values per expected feature and in the score."""
    return null_counts(train, PROFILE_FEATURES + ["score"])


def score_brackets(weekly: DataFrame) -> DataFrame:
    """Count and share per severity bracket with overall mean, population sd and zero share."""
    s = F.col("score")
    wide = weekly.agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"),
        zero_share().alias("zero_share"),
        *[F.count(F.when(in_bin(s, low, high), 1)).alias(f"n{i}") for i, (_, low, high) in enumerate(SEVERITY_BINS)])
    return wide.select("mean", "sd", "zero_share", _rows(*[
        F.struct(F.lit(label).alias("bracket"), F.col(f"n{i}").alias("count"),
                 F.try_divide(F.col(f"n{i}"), F.col("n")).alias("share"))
        for i, (label, _, _) in enumerate(SEVERITY_BINS)]))


def feature_shift(train: DataFrame, test: DataFrame, cols: list[str] = COMPARED_FEATURES) -> DataFrame:
    """Means, their ratio and the 99th percentiles of both cohorts with a danger level."""
    cols = [c for c in present(cols, train) if c in test.columns]
    sides = []
    for p, df in (("tr", train), ("te", test)):
        wide = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)])
        tops = quantiles(long_form(df, cols), [0.99]).select(F.col("grp").alias("feature"), F.col("quantile").alias(f"{p}_p99"))
        sides.append(_wide_to_rows(wide, cols, {f"{p}_mean": "m"}).join(F.broadcast(tops), "feature", "left"))
    both = sides[0].join(F.broadcast(sides[1]), "feature")
    pct = (F.col("te_p99") - F.col("tr_p99")) / (F.abs("tr_p99") + 1e-9) * 100
    # A mean that is 0 but for the order of summation counts as 0.
    return both.withColumn("ratio", F.col("te_mean") / (F.round("tr_mean", 12) + 1e-9)).withColumn("p99_pct", pct).withColumn(
        "danger", F.when(pct > 15, 2).when(pct > 8, 1).otherwise(0))


def level_profile(weekly: DataFrame, cols: list[str] = DROUGHT_FEATURES) -> DataFrame:
    """Mean of each feature per severity level and how extreme compares to safe."""
    cols, s = present(cols, weekly), F.col("score")
    wide = weekly.agg(*[
        F.avg(F.when(in_bin(s, low, high), F.col(c))).alias(f"{name}_{i}")
        for i, c in enumerate(cols) for name, low, high in LEVELS])
    out = _wide_to_rows(wide, cols, {f"{name}_mean": f"{name}_" for name, _, _ in LEVELS})
    times = F.col("ext_mean") / (F.abs("safe_mean") + 1e-6)
    return out.withColumn("multiplier", times).withColumn("flag", F.when(times > 2.0, 2).when(times > 1.3, 1).otherwise(0))


def level_counts(weekly: DataFrame) -> DataFrame:
    s = F.col("score")
    wide = weekly.agg(F.count("score").alias("n"), *[
        F.count(F.when(in_bin(s, low, high), 1)).alias(name) for name, low, high in LEVELS])
    return wide.select(_rows(*[
        F.struct(F.lit(name).alias("level"), F.col(name).alias("count"), F.try_divide(F.col(name), F.col("n")).alias("share"))
        for name, _, _ in LEVELS]))


# --- correlations ------------------------------------------------------------------

def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, over the rows where both are present.

    Each task reduces its rows to sums per pair with matrix products and hands on one row per pair.
    Values are first shifted by the column means, which keeps the sums of products well scaled.
    """
    centre = df.agg(*[F.avg(c).alias(c) for c in cols]).first()
    shift = np.array([0.0 if centre[c] is None else centre[c] for c in cols])
    k = len(cols)
    a, b = (m.ravel() for m in np.meshgrid(np.arange(k), np.arange(k), indexing="ij"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((4, k, k))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - shift
            has = ~np.isnan(x)
            x = np.where(has, x, 0.0)
            has = has.astype(float)
            total += np.stack([has.T @ has, x.T @ has, (x * x).T @ has, x.T @ x])
        yield pd.DataFrame({"a": a, "b": b, **{n: m.ravel() for n, m in zip(("n", "s", "q", "p"), total)}})

    schema = "a long, b long, n double, s double, q double, p double"
    parts = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(sums, schema)
    both = parts.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "p")])
    # s and q are sums over column a where b is present; the mirrored pair has those of b.
    other = both.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("s").alias("s2"), F.col("q").alias("q2"))
    n = F.col("n")
    cov = F.col("p") - F.col("s") * F.col("s2") / n
    spread = F.sqrt((F.col("q") - F.col("s") * F.col("s") / n) * (F.col("q2") - F.col("s2") * F.col("s2") / n))
    name = lambda c: F.element_at(F.array(*[F.lit(x) for x in cols]), F.col(c).cast("int") + 1).alias(c)
    pairs = both.filter(n > 1).join(F.broadcast(other), ["a", "b"])
    return pairs.select(name("a"), name("b"), F.try_divide(cov, spread).alias("r"))


def rank_columns(df: DataFrame, cols: list[str], ids: list[str]) -> DataFrame:
    """``cols`` replaced by their average ranks; rows must be complete."""
    ranked = average_ranks(long_form(df, cols, ids), ids).select(*ids, "grp", "rank")
    return ranked.groupBy(*ids).agg(*[F.max(F.when(F.col("grp") == c, F.col("rank"))).alias(c) for c in cols])


def spearman_matrix(df: DataFrame, cols: list[str], ids: list[str] = ()) -> DataFrame:
    """(a, b, r) of all pairs of columns, over the rows where both are present. ``ids`` are not needed."""
    return rank_matrix.spearman_matrix(df, cols).drop("n")


#: Coefficients of log(erfc(x) / t) + x^2 in t = 2 / (2 + x), fractional error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587,
        -0.82215223, 0.17087277)


def log_p_value(r: Column, n: Column) -> Column:
    """Natural log of the two-sided p-value of a correlation ``r`` over ``n`` rows.

    t has n - 2 degrees of freedom and is turned into a normal deviate (Wallace); logs keep very small values.
    """
    free = n - 2
    t2 = free * r * r / (1 - r * r)
    z = (8 * free + 1) / (8 * free + 3) * F.sqrt(free * F.log1p(t2 / free))
    x = z / F.sqrt(F.lit(2.0))
    t = 2 / (2 + x)
    poly = F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    return F.log(t) - x * x + poly


def spearman_with_score(weekly: DataFrame, cols: list[str] = DROUGHT_FEATURES) -> DataFrame:
    """Rank correlation of each feature with the score, by magnitude, with p-value and significance stars."""
    cols = present(cols, weekly)
    whole = weekly.dropna(subset=cols + ["score"])
    matrix = rank_matrix.spearman_matrix(whole, cols + ["score"])
    out = matrix.filter((F.col("b") == "score") & (F.col("a") != "score")).select("n", F.col("a").alias("feature"), "r")
    r = F.col("r")
    log_p = F.when((F.abs(r) < 1) & (F.col("n") > 2), log_p_value(r, F.col("n")))
    out = out.withColumn("log10_p", log_p / F.log(F.lit(10.0)))
    out = out.withColumn("p_value", F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(F.exp(log_p)))
    p = F.col("p_value")
    stars = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    return out.select("feature", "n", "r", "p_value", "log10_p", stars.alias("stars")).orderBy(F.desc(F.abs(r)))


def score_ranking(matrix: DataFrame) -> DataFrame:
    """Features by strength of their correlation with the score."""
    return matrix.filter((F.col("b") == "score") & (F.col("a") != "score")).select(
        F.col("a").alias("feature"), "r").orderBy(F.desc(F.abs("r")))


# --- structure ---------------------------------------------------------------------

def region_series(weekly: DataFrame, n: int = 5, order: Column | None = None) -> DataFrame:
    """Series of ``n`` regions picked by a hash, sorted for display."""
    order = F.xxhash64(KEY) if order is None else order
    picked = weekly.select(KEY).distinct().orderBy(order, KEY).limit(n)
    cols = present(["tmp", "humidity", "prec", "wind", "score"], weekly)
    return weekly.join(F.broadcast(picked), KEY, "left_semi").select(
        KEY, "week_idx", "day_ordinal", *cols).orderBy(KEY, "week_idx")


def cyclic_audit(weekly: DataFrame) -> DataFrame:
    s, c = F.col("week_sin"), F.col("week_cos")
    return weekly.agg(
        F.min(s).alias("sin_min"), F.max(s).alias("sin_max"), F.min(c).alias("cos_min"),
        F.max(c).alias("cos_max"), F.avg(F.sqrt(s * s + c * c)).alias("mean_radius"))


def weeks_per_region(df: DataFrame) -> DataFrame:
    return df.groupBy(KEY).agg(F.count(F.lit(1)).alias("weeks"))


def weeks_histogram(train: DataFrame, test: DataFrame) -> DataFrame:
    parts = [histogram(weeks_per_region(df), "weeks", bins).select(F.lit(name).alias("cohort"), "bin", "count")
             for name, df, bins in (("train", train, 30), ("test", test, 20))]
    return parts[0].unionByName(parts[1])


def region_gaps(train: DataFrame, test: DataFrame) -> DataFrame:
    """Whole weeks between the last train and the first test day, per common region."""
    last = train.groupBy(KEY).agg(F.max("day_ordinal").alias("_a"))
    first = test.groupBy(KEY).agg(F.min("day_ordinal").alias("_b"))
    return last.join(first, KEY).select(KEY, F.rint((F.col("_b") - F.col("_a")) / 7.0).cast("long").alias("gap"))


def deployment_gap(train: DataFrame, test: DataFrame) -> DataFrame:
    gaps = region_gaps(train, test)
    mid = quantiles(gaps.select(F.lit("gap").alias("grp"), F.col("gap").cast("double").alias("value")), [0.5])
    ends = gaps.agg(F.min("gap").alias("gap_min"), F.max("gap").alias("gap_max"), F.avg("gap").alias("gap_mean"))
    return ends.withColumn("gap_median", mid.select("quantile").scalar().cast("long"))


def available_windows(train: DataFrame, median_gap: Column | int = 4, window: int = WINDOW, horizon: int = HORIZON) -> DataFrame:
    left = F.col("weeks") - window - median_gap - horizon
    return weeks_per_region(train).select(KEY, F.greatest(left, F.lit(0)).cast("long").alias("windows"))


def cluster_profile(assigned: DataFrame, weekly: DataFrame, cols: list[str]) -> DataFrame:
    """Size and centroid of each cluster with its later scores, wettest first."""
    scores = weekly.groupBy(KEY).agg(F.avg("score").alias("score_mean"), zero_share().alias("score_zero_prob"))
    df = assigned.select(KEY, "cluster_id", *cols).join(scores, KEY, "left")
    return df.groupBy("cluster_id").agg(
        F.count(KEY).alias("regions"),
        *[F.round(F.avg(c), 4).alias(c) for c in cols + ["score_mean", "score_zero_prob"]]).orderBy(F.desc("prec_mean"))


def cluster_spread(assigned: DataFrame, cols: list[str]) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(*[F.round(F.stddev_samp(c), 4).alias(c) for c in cols])


def cluster_boxes(assigned: DataFrame, cols: list[str]) -> DataFrame:
    long = long_form(assigned, cols, ["cluster_id"]).select(
        F.concat_ws("|", F.col("cluster_id").cast("string"), "grp").alias("grp"), "value")
    return box_stats(long).select(
        F.split_part("grp", F.lit("|"), F.lit(1)).cast("long").alias("cluster_id"),
        F.split_part("grp", F.lit("|"), F.lit(2)).alias("feature"),
        "q1", "median", "q3", "whisker_low", "whisker_high", "outliers", "n")


def cluster_pairs(assigned: DataFrame) -> DataFrame:
    return assigned.select("cluster_id", *present(["tmp_mean", "prec_mean", "humidity_mean", "wind_mean"], assigned))


# --- sampling and folds --------------------------------------------------------------

SAMPLE_BUCKETS = 65_536


def hash_order(ids: list[str], seed: int) -> Column:
    return F.xxhash64(*ids, F.lit(seed))


def _big(n: int) -> Column:
    """Differences of longs may not fit a long."""
    return F.lit(str(n)).cast("decimal(38,0)")


def seeded_sample(df: DataFrame, n: int, ids: list[str], seed: int = 42, order: Column | None = None) -> DataFrame:
    """The ``n`` rows of least ``order`` (a long, by default a hash of the ids); the same ones every time.

    Counts of the leading parts of ``order`` give the part in which the n-th row lies. Rows of lower
    parts are taken where they are and only that part, which is cut again while it is large, is sorted.
    """
    rows = df.withColumn("_o", hash_order(ids, seed) if order is None else order)
    ends = rows.agg(F.min("_o").alias("lo"), F.max("_o").alias("hi")).first()
    if ends["lo"] is None or n <= 0:
        return df.limit(0)
    lo, hi, taken, left = ends["lo"], ends["hi"], None, n
    while True:
        width = max(1, -(-(hi - lo + 1) // SAMPLE_BUCKETS))
        inside = rows.filter((F.col("_o") >= lo) & (F.col("_o") <= hi))
        part = F.floor((F.col("_o").cast("decimal(38,0)") - _big(lo)) / _big(width)).cast("long")
        counts = inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
        border = None
        for r in counts:  # at most SAMPLE_BUCKETS numbers
            if r["n"] > left:
                border = r
                break
            left -= r["n"]
        if border is None:
            taken = F.col("_o") <= hi
            return rows.filter(taken).drop("_o")
        lo = lo + border["part"] * width
        hi = min(hi, lo + width - 1)
        if border["n"] <= SAMPLE_BUCKETS or width == 1:
            edge = rows.filter((F.col("_o") >= lo) & (F.col("_o") <= hi)).orderBy("_o", *ids).limit(left)
            return rows.filter(F.col("_o") < lo).unionByName(edge).drop("_o")


FOLD_BUCKET_ROWS = 100_000


def stratified_folds(df: DataFrame, order: Column, k: int = 3) -> DataFrame:
    """Deal the rows of each label out to ``k`` folds in the order of ``order``, a long.

    Rows are numbered within even ranges of ``order``, as many as keep one near ``FOLD_BUCKET_ROWS`` rows
    if the order is hash-like, and continue where the earlier ranges of the label stop.
    """
    rows = df.withColumn("_order", order)
    ends = rows.agg(F.min("_order").alias("lo"), F.max("_order").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-ends["n"] // FOLD_BUCKET_ROWS))
    lo, width = ends["lo"] or 0, max(1, -(-((ends["hi"] or 0) - (ends["lo"] or 0) + 1) // parts))
    block = F.floor((F.col("_order").cast("decimal(38,0)") - _big(lo)) / _big(width)).cast("long")
    dealt = dense_position(rows, ["_order"], block, out="_pos", key="label")
    return dealt.select(*df.columns, (F.col("_pos") % k).cast("int").alias("fold"))
