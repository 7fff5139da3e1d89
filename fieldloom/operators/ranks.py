"""Exact ranks, quantiles and rank statistics without one global sort.

Values are cut at approximate quantiles of their group into buckets whose exact sizes are counted. A
bucket with more than ``ROWS_PER_BUCKET`` rows is cut again, at quantiles of its own, until none is left, so the
number of buckets grows with the rows. A value that equals a cut gets a bucket of its own; a heavy value (every
value with a noticeable share of a bucket is a cut) is ranked from its count alone and never sorted.

The placed rows are stored, so bucket counts and contents come from the same values even if the input is
a plan whose averages differ in the last bit between two evaluations. The cuts only balance the work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

CUTS = 256
ROWS_PER_BUCKET = 500_000


def long_form(df: DataFrame, cols: list[str], ids: list[str] = ()) -> DataFrame:
    """(ids..., grp = column name, value) without missing values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("grp"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*ids, F.inline(pairs)).filter(F.col("value").isNotNull())


@dataclass
class Placed:
    """Stored rows with ``gid`` and ``bucket``, and the bucket sizes (gid, bucket, n, before, total).

    A bucket is the list of its numbers on each level; lists sort like the values. An odd last
    number marks the bucket of a single value.
    """

    rows: DataFrame
    sizes: DataFrame


def _cuts() -> Column:
    probs = [i / CUTS for i in range(1, CUTS)]
    return F.sort_array(F.array_distinct(F.percentile_approx("value", probs, 20 * CUTS)))


def _bucket_in(cuts: Column, value: Column, rows: DataFrame) -> DataFrame:
    """``rows`` with ``_b``: 2k for values between cuts k-1 and k, 2k+1 for those equal to cut k.

    k, the number of cuts below the value, is found by halving steps written out as one column
    each, which stay inside generated code.
    """
    out = rows.withColumn("_k", F.lit(0))
    for step in (2 ** i for i in reversed(range(CUTS.bit_length()))):
        below = F.get(cuts, F.col("_k") + (step - 1)) < value
        out = out.withColumn("_k", F.col("_k") + F.when(below, step).otherwise(0))
    hit = F.coalesce(F.get(cuts, F.col("_k")) == value, F.lit(False)).cast("int")
    return out.withColumn("_b", 2 * F.col("_k") + hit).drop("_k")


def _single() -> Column:
    return F.element_at("bucket", -1) % 2 == 1


def _with_before(sizes: DataFrame) -> DataFrame:
    by_bucket = Window.partitionBy("gid").orderBy("bucket")
    earlier = F.sum("n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("gid", "bucket", "n", F.coalesce(earlier, F.lit(0)).alias("before"),
                        F.sum("n").over(Window.partitionBy("gid")).alias("total"))


def _holding(sizes: DataFrame, probs: list[float]) -> DataFrame:
    """The buckets that hold a rank of one of ``probs``, with that rank."""
    return (
        sizes.select("gid", "bucket", "n", "before", "total", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .withColumn("_h", (F.col("total") - 1) * F.col("prob"))
        .withColumn("lo", F.floor("_h")).withColumn("hi", F.ceil("_h"))
        .withColumn("frac", F.col("_h") - F.col("lo"))
        .filter((F.col("before") <= F.col("hi")) & (F.col("lo") < F.col("before") + F.col("n")))
    )


def place(long: DataFrame, weight: str | None = None, probs: list[float] | None = None) -> Placed:
    """Deal the values of each ``grp`` into buckets; sizes count rows, or add up ``weight``.

    There is one group per compared column, table or cluster, so the first cuts are a small table.
    Later cuts are joined by bucket; their number grows with the rows and Spark picks the join. Only rows of buckets
    that are cut again are stored again. With ``probs`` these are the ones that hold a wanted rank.
    """
    groups = stage(long.groupBy("grp").agg(_cuts().alias("_cuts")).withColumn(
        "gid", F.monotonically_increasing_id()), "rank-groups")
    first = _bucket_in(F.col("_cuts"), F.col("value"), long.join(F.broadcast(groups), "grp")).drop("_cuts")
    rows = stage(first.withColumn("bucket", F.array("_b")).drop("_b"), "rank-rows")
    while True:
        counts = stage(rows.groupBy("gid", "bucket").agg(F.count(F.lit(1)).alias("n")), "rank-counts")
        cut = counts if probs is None else _holding(_with_before(counts), probs)
        large = stage(cut.filter((F.col("n") > ROWS_PER_BUCKET) & ~_single()).select("gid", "bucket").distinct(), "rank-large")
        if not large.limit(1).count():
            break
        own = rows.join(large, ["gid", "bucket"]).groupBy("gid", "bucket").agg(_cuts().alias("_cuts"))
        joined = rows.join(stage(own, "rank-cuts"), ["gid", "bucket"])
        deeper = _bucket_in(F.col("_cuts"), F.col("value"), joined).withColumn("bucket", F.concat("bucket", F.array("_b")))
        deeper = stage(deeper.drop("_cuts", "_b"), "rank-rows")
        rows = rows.join(large, ["gid", "bucket"], "left_anti").unionByName(deeper)
    sizes = counts if weight is None else rows.groupBy("gid", "bucket").agg(F.sum(weight).alias("n"))
    return Placed(rows, stage(_with_before(sizes), "rank-sizes"))


def average_ranks(long: DataFrame, row: list[str]) -> DataFrame:
    """(row..., grp, value, rank): ties share their mean rank within ``grp``.

    ``row`` names the columns that identify a row. Rows of a single value stay where they are: their rank follows from its count.
    """
    placed = place(long)
    rows = placed.rows.select(*row, "grp", "value", "gid", "bucket")
    # One row per bucket, of which there are at most some hundreds for ``ROWS_PER_BUCKET`` rows and more.
    sizes = F.broadcast(placed.sizes.select("gid", "bucket", "n", "before"))
    heavy = rows.filter(_single()).join(sizes, ["gid", "bucket"]).withColumn("rank", F.col("before") + (F.col("n") + 1) / 2.0)
    w = Window.partitionBy("gid", "bucket").orderBy("value")
    up_to = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = rows.filter(~_single()).withColumn("_lo", F.rank().over(w)).withColumn("_hi", up_to)
    other = ranked.join(sizes, ["gid", "bucket"]).withColumn("rank", F.col("before") + (F.col("_lo") + F.col("_hi")) / 2.0)
    return heavy.unionByName(other.drop("_lo", "_hi")).drop("n", "before", "bucket", "gid")


def value_counts(long: DataFrame) -> DataFrame:
    return long.groupBy("grp", "value").agg(F.count(F.lit(1)).alias("cnt"))


def cumulative_counts(long: DataFrame) -> DataFrame:
    """(grp, value, cnt, before, total): how many rows of the group lie strictly below."""
    placed = place(value_counts(long), weight="cnt")
    w = Window.partitionBy("gid", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.rows.withColumn("_in", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
        .join(placed.sizes, ["gid", "bucket"])
        .select("grp", "value", "cnt", (F.col("before") + F.col("_in")).alias("before"), "total")
    )


def quantiles(long: DataFrame, probs: list[float]) -> DataFrame:
    """(grp, prob, quantile): exact, linear between neighbouring order statistics.

    Only the buckets that hold a wanted rank are cut again and sorted.
    """
    return placed_quantiles(place(long, probs=probs), probs)


def placed_quantiles(placed: Placed, probs: list[float]) -> DataFrame:
    wanted = _holding(placed.sizes, probs)
    # A few ranks per group: at most two buckets for each.
    needed = wanted.select("gid", "bucket").distinct()
    kept = placed.rows.join(F.broadcast(needed), ["gid", "bucket"], "left_semi")
    counts = kept.groupBy("grp", "gid", "bucket", "value").agg(F.count(F.lit(1)).alias("cnt"))
    w = Window.partitionBy("gid", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_in", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    ranked = counts.join(F.broadcast(wanted), ["gid", "bucket"]).withColumn(
        "_from", F.col("before") + F.col("_in"))
    holds = lambda r: (F.col("_from") <= F.col(r)) & (F.col(r) < F.col("_from") + F.col("cnt"))
    found = ranked.groupBy("grp", "prob").agg(
        F.max(F.when(holds("lo"), F.col("value"))).alias("_a"),
        F.max(F.when(holds("hi"), F.col("value"))).alias("_b"), F.max("frac").alias("_f"))
    return found.select("grp", "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias("quantile"))


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve from rank sums; ties count half."""
    long = scored.select(F.lit("all").alias("grp"), F.col(score).cast("double").alias("value"),
                         F.col(label).cast("long").alias("_y"))
    counts = long.groupBy("grp", "value").agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("_y").alias("_pos"))
    placed = place(counts, weight="cnt")
    w = Window.partitionBy("gid", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        placed.rows.withColumn("_in", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
        .join(placed.sizes, ["gid", "bucket"])
        .withColumn("_rank", F.col("before") + F.col("_in") + (F.col("cnt") + 1) / 2.0)
    )
    sums = ranked.agg(F.sum(F.col("_rank") * F.col("_pos")).alias("r"),
                      F.sum("_pos").cast("double").alias("p"), F.sum("cnt").cast("double").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(F.try_divide(F.col("r") - p * (p + 1) / 2.0, p * q).alias("auc"))
