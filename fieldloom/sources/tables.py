"""Reading and writing of processed panels, statistics, predictions and forecasts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..operators.distributions import submission_values


def write_panel(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by) if partition_by else df.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def export_processed(train: DataFrame, test: DataFrame, folder: str, fmt: str = "parquet") -> None:
    write_panel(train, f"{folder}/train", fmt)
    write_panel(test, f"{folder}/test", fmt)


def write_region_stats(stats: DataFrame, folder: str, fmt: str = "parquet") -> None:
    write_panel(stats, f"{folder}/region_stats", fmt)


#: Types of the columns of processed tables that are not doubles; dates stay text.
TYPES = {"region_id": "long", "week_idx": "long", "day_ordinal": "long", "week_end_date": "string", "cluster_id": "byte",
         "is_dry_spell": "byte"}


def csv_schema(spark: SparkSession, path: str, types: dict[str, str] = TYPES) -> str:
    """Declared types for the columns that the header names; the rows are not read."""
    return ", ".join(f"`{c}` {types.get(c, 'double')}" for c in spark.read.option("header", True).csv(path).columns)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    if fmt == "parquet":
        return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)
    return spark.read.schema(schema or csv_schema(spark, path)).option("header", True).csv(path)


def read_processed(spark: SparkSession, folder: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Train and test panels (an error if absent) and the region statistics, if there are any."""
    train, test = (read_table(spark, f"{folder}/{name}", fmt) for name in ("train", "test"))
    try:
        stats = read_table(spark, f"{folder}/region_stats", fmt)
    except AnalysisException:
        stats = None
    return train, test, stats


def write_predictions(preds: DataFrame, path: str) -> None:
    """Raw predictions in long form (fold, region_id, horizon, pred_a, prob_b)."""
    preds.write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_submission(wide: DataFrame, folder: str, mode: str, single_file: bool = False) -> str:
    """One CSV folder per gating mode; ``single_file`` gathers it for some thousand regions."""
    path = f"{folder}/submission_{mode}"
    out = wide.coalesce(1) if single_file else wide
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_submissions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(grp = model, value) of all submissions that exist; the first column is the key."""
    parts = []
    for model, path in paths.items():
        try:
            wide = read_table(spark, path, "csv")
        except AnalysisException:
            continue
        parts.append(submission_values(wide, model))
    if not parts:
        raise FileNotFoundError("none of the submissions exists")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
