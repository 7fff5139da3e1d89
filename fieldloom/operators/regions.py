"""Region statistics and climate clusters."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from ..constants import CLUSTER_FEATURES_V51, CLUSTER_RESTARTS, CLUSTERS, SEED
from .impute import with_row
from .splits import KEY, attach


def zero_share(score: str = "score"):
    """Share of exact zeros among present values."""
    return F.avg(F.when(F.col(score) == 0, 1.0).when(F.col(score).isNotNull(), 0.0))


def region_stats_v51(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy(KEY).agg(
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("score_mean"),
        F.coalesce(zero_share(), F.lit(0.5)).alias("score_zero_prob"),
        F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("score_std"),
        F.coalesce(F.avg("tmp"), F.lit(0.0)).alias("tmp_mean"),
        F.coalesce(F.avg("prec"), F.lit(0.0)).alias("prec_mean"),
    )


def region_stats_v54(weekly: DataFrame) -> DataFrame:
    aggs = []
    for c in ("tmp", "prec", "humidity", "wind"):
        aggs += [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean"),
                 F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")]
    return weekly.groupBy(KEY).agg(*aggs)


def standardise(stats: DataFrame, cols: list[str]) -> DataFrame:
    """Centre and divide by the population sd (a constant column is only centred)."""
    one = stats.agg(
        *[F.avg(c).alias(f"{c}_mu") for c in cols], *[F.stddev_pop(c).alias(f"{c}_sd") for c in cols])
    sd = lambda c: F.when(F.col(f"_one.{c}_sd") == 0, F.lit(1.0)).otherwise(F.col(f"_one.{c}_sd"))
    scaled = {c: (F.col(c) - F.col(f"_one.{c}_mu")) / sd(c) for c in cols}
    return with_row(stats, one).withColumns(scaled).drop("_one")


def cluster_regions(
    stats: DataFrame, cols: list[str] = CLUSTER_FEATURES_V51, k: int = CLUSTERS,
    restarts: int = CLUSTER_RESTARTS, seed: int = SEED, parallelism: int = 5, most_steps: int = 1_000,
) -> DataFrame:
    """Add ``cluster_id``: k-means on standardised statistics, least cost of several restarts, until no centre moves.

    Labels are renumbered from the wettest cluster to the driest, which makes them stable.
    """
    raw = VectorAssembler(inputCols=cols, outputCol="_raw").transform(stats)
    scaler = StandardScaler(withMean=True, inputCol="_raw", outputCol="_x").fit(raw)
    points = scaler.transform(raw).persist()
    means = lambda i: KMeans(k=k, featuresCol="_x", predictionCol="_label", seed=seed + i)
    with ThreadPoolExecutor(parallelism) as pool:
        models = list(pool.map(lambda i: means(i).fit(points), range(restarts)))
    chosen = min(range(restarts), key=lambda i: models[i].summary.trainingCost)
    # The restarts stop after a few steps, with points that are nearer to another cluster. The best one goes on to the end.
    best = means(chosen).setMaxIter(most_steps).setTol(0.0).fit(points)
    labelled = best.transform(points).drop("_raw", "_x")
    points.unpersist()
    # At most k rows, whatever the number of regions.
    rank = F.row_number().over(Window.orderBy(F.desc("_wet"), "_label")) - 1
    names = labelled.groupBy("_label").agg(F.avg("prec_mean").alias("_wet")).select(
        "_label", rank.cast("byte").alias("cluster_id"))
    return labelled.join(F.broadcast(names), "_label").drop("_label")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("regions"))


def assign_clusters(weekly: DataFrame, assigned: DataFrame, unseen: int | None = 0) -> DataFrame:
    """Attach ``cluster_id``; regions without one get ``unseen``."""
    out = attach(weekly, assigned.select(KEY, "cluster_id"), "week_idx")
    if unseen is None:
        return out
    return out.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(unseen).cast("byte")))
