"""Text conventions shared by the operators: six ASCII white-space characters, A-Z lower-casing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Texts without other letters take the faster built-in."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def aside(docs: DataFrame, new: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns named like ``new`` ones renamed, and the names to give them back."""
    back: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in new:
            other = free_name(docs, f"_own_{c}")
            docs, back[other] = docs.withColumnRenamed(c, other), c
    return docs, back


ARROW_BYTES = 4 << 20


def small_batches(docs: DataFrame) -> None:
    """Have the session hand texts to Python in batches of a few megabytes; a smaller setting stays.

    Each task holds a batch several times (JVM buffers, Arrow, numpy), so the default of 64 MB costs memory for nothing.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(docs.sparkSession.conf.get(key, "67108864").rstrip("bB"))
    if not 0 < now <= ARROW_BYTES:
        docs.sparkSession.conf.set(key, str(ARROW_BYTES))
