"""Target encoding of regions, learnt per fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..constants import ENCODED, HORIZON, WINDOW
from .regions import zero_share
from .splits import KEY, attach

MEAN, ZERO = ENCODED


def fit_encoding(scores: DataFrame) -> DataFrame:
    """Mean score and zero share per fold and region."""
    return scores.groupBy("fold", KEY).agg(F.avg("score").alias(MEAN), zero_share().alias(ZERO))


def encoding_fallback(encoding: DataFrame) -> DataFrame:
    """What an unseen region gets in each fold: the plain mean over regions."""
    return encoding.groupBy("fold").agg(F.avg(MEAN).alias(f"_{MEAN}"), F.avg(ZERO).alias(f"_{ZERO}"))


def with_encodings(samples: DataFrame, encoding: DataFrame, row: str | None = None) -> DataFrame:
    """Add ``own`` and ``plain``, maps of fold to (mean, zero share), to samples keyed by region.

    One join by region serves all folds, so samples need not be copied or moved for each. ``row`` names a
    column that numbers the samples of a region; a hot region is then divided over it. ``plain`` is the
    fallback, one entry per fold.
    """
    pair = F.struct(F.col(MEAN).alias("m"), F.col(ZERO).alias("z"))
    dim = encoding.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("fold", pair))).alias("own"))
    plain = F.struct(F.col(f"_{MEAN}").alias("m"), F.col(f"_{ZERO}").alias("z"))
    fallback = encoding_fallback(encoding).agg(F.map_from_entries(F.collect_list(F.struct("fold", plain)))).scalar()
    joined = samples.join(dim, KEY, "left") if row is None else attach(samples, dim, row)
    return joined.withColumn("plain", fallback)


def pick_encoding(samples: DataFrame) -> DataFrame:
    """The encodings of each row's fold as two columns."""
    own, plain = F.col("own")[F.col("fold")], F.col("plain")[F.col("fold")]
    return samples.withColumn(MEAN, F.coalesce(own["m"], plain["m"])).withColumn(
        ZERO, F.coalesce(own["z"], plain["z"])).drop("own", "plain")


def attach_encoding(samples: DataFrame, encoding: DataFrame, row: str | None = None) -> DataFrame:
    """Add both encodings to samples that have a fold."""
    return pick_encoding(with_encodings(samples, encoding, row))


def per_fold(test_samples: DataFrame, encoding: DataFrame) -> DataFrame:
    """Test samples once per fold, each with that fold's encoding."""
    ready = with_encodings(test_samples, encoding)
    return pick_encoding(ready.withColumn("fold", F.explode(F.map_keys("plain"))))


def flat_with_encoding(samples: DataFrame, n_features: int, window: int = WINDOW) -> DataFrame:
    """Insert the encodings into ``x`` at their place: after each week's features, delta 0.

    Expects ``x`` flattened over ``n_features`` columns; the result has ``n_features + 2`` a week.
    """
    pair = F.array(F.col(MEAN).cast("float"), F.col(ZERO).cast("float"))
    zeros = F.array(F.lit(0.0).cast("float"), F.lit(0.0).cast("float"))
    parts = []
    for w in range(window + 1):
        parts += [F.slice("x", w * n_features + 1, n_features), pair if w < window else zeros]
    return samples.withColumn("x", F.concat(*parts))


def horizons(samples: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Long form of the targets: one row per sample and horizon, with the occurrence label."""
    long = samples.select("*", F.posexplode("y").alias("_h", "y_true")).drop("y")
    return long.select(
        *[c for c in long.columns if c not in ("_h",)], (F.col("_h") + 1).alias("horizon"),
        (F.col("y_true") > 0).cast("int").alias("occurs")).filter(F.col("horizon") <= horizon)
