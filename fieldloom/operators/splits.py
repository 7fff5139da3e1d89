"""Ordered windows over regions of any size.

A window partitioned by region alone would put a region that holds a third of all rows into one
task. Here every region is cut into chunks of a fixed number of positions; boundary rows are also
sent to the neighbouring chunk (its halo), so frames that reach a known number of rows back or
ahead see all their rows, and halo rows are dropped afterwards. Unbounded frames carry one summary
row per chunk instead (see ``impute``).
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

KEY = "region_id"
CHUNK = "chunk"
CHUNK_WEEKS = 512


def week_rows() -> int:
    return CHUNK_WEEKS


def day_rows() -> int:
    """A multiple of seven, so that no week straddles two chunks."""
    return CHUNK_WEEKS * 7


def dense_position(
    df: DataFrame, order: list[str], block: Column, out: str = "pos", key: str = KEY,
) -> DataFrame:
    """Number the rows of each region 0, 1, ... by ``order``.

    ``block`` must not decrease along ``order`` and bounds how many rows meet in one window group:
    rows are numbered within (region, block) and shifted by the size of the earlier blocks.
    """
    df = df.withColumn("_block", block)
    sizes = df.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    number = F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order))
    return (
        df.join(shifts, [key, "_block"])
        .withColumn(out, (F.col("_shift") + number - 1).cast("long"))
        .drop("_block", "_shift")
    )


def own_chunk(pos: str, rows: int) -> Column:
    return F.floor(F.col(pos) / F.lit(rows))


def spread(df: DataFrame, pos: str, rows: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Assign rows to chunks and copy boundary rows into the halo of the neighbouring chunk."""
    if max(back, ahead) > rows:
        raise ValueError("a halo cannot be longer than a chunk")
    own = own_chunk(pos, rows)
    if not back and not ahead:
        return df.withColumn(CHUNK, own)
    at = F.pmod(F.col(pos), F.lit(rows))
    homes = [own]
    if back:
        homes.append(F.when(at >= rows - back, own + 1))
    if ahead:
        homes.append(F.when((at < ahead) & (own > 0), own - 1))
    return df.withColumn(CHUNK, F.explode(F.array_compact(F.array(*homes))))


def trim(df: DataFrame, pos: str, rows: int) -> DataFrame:
    return df.filter(F.col(CHUNK) == own_chunk(pos, rows)).drop(CHUNK)


def chunk_window(pos: str) -> WindowSpec:
    return Window.partitionBy(KEY, CHUNK).orderBy(pos)


def weekly_frames(back: int):
    """Decorator for operators whose frames reach ``back`` weeks back.

    Called on a frame that is already spread (it has a chunk column) the operator adds its columns
    and leaves the halo to the caller, so several operators share one shuffle.
    """
    def wrap(op):
        @functools.wraps(op)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            if CHUNK in df.columns:
                return op(df, *args, **kwargs)
            out = op(spread(df, "week_idx", week_rows(), back=back), *args, **kwargs)
            return trim(out, "week_idx", week_rows())
        return run
    return wrap


def attach(df: DataFrame, dim: DataFrame, row: str, salts: int = 32, how: str = "left") -> DataFrame:
    """Join a table with one row per region, or a few.

    The number of regions has no bound, so no broadcast is forced: ``dim`` itself is joined where Spark would broadcast
    it. Otherwise the rows of a hot region are divided among ``salts`` copies of its ``dim`` row, and these
    are never broadcast: Spark takes them for as small as ``dim``, and the driver would hold all of them.
    """
    if _broadcast_fits(dim):
        return df.join(dim, KEY, how)
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = df.withColumn("_salt", F.pmod(F.col(row), F.lit(salts)).cast("int"))
    return salted.join(copies.hint("shuffle_hash"), [KEY, "_salt"], how).drop("_salt")


def _broadcast_fits(dim: DataFrame) -> bool:
    most = dim.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(dim._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most
