"""Dropping lines found in many documents, with line counts kept as levelled sorted runs.

``LineRuns`` is a log-structured store of (line hash, number of documents): a batch becomes a run at level 0, sorted by
hash; ``fanout`` runs of a level are merged into one run of the next and then removed. A run keeps the keys that have
reached the document limit apart from the others. Every batch anti-joins the frequent keys found so far and adds only its
other keys, so a very common line is stored once and not counted again; frequent parts are compacted in the same way. The
number of batches grows with the lines, and there are never fewer than ``fanout`` squared, so that two levels are reached.
All of it is DataFrame code.

Definitions: a null or empty text is one empty line. A key is the line without white space at its ends,
A-Z lower-cased; keys shorter than ``min_chars`` are never dropped. Rows equal in id and text are one
document. Rows with a null id are documents like others.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_folder, stage
from .text import SPACES, ascii_lower, aside, free_name

NEW = ("kept_text", "n_lines", "n_dropped")
RUN = "h1 long, h2 long, n long"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def key_hash(key: Column) -> Column:
    """128 bits as a struct of two longs."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


class LineRuns:
    """Sorted runs of line counts by level, compacted when a level holds ``fanout`` runs.

    ``anti_joins`` counts batches that met frequent keys, ``merges`` the compactions of each level.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.folder = f"{shared_folder(spark)}/fieldloom/line-runs-{uuid.uuid4().hex}"
        self.levels: list[list[str]] = [[]]
        self.frequent_runs: list[str] = []
        self.anti_joins, self.merges = 0, [0]
        self._written = 0

    def _read(self, paths: list[str], frequent: bool) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], RUN)
        runs = self.spark.read.schema(f"{RUN}, run int, frequent boolean").option("basePath", f"{self.folder}/runs").parquet(*paths)
        return runs.filter(F.col("frequent") == frequent).select("h1", "h2", "n")

    def _write(self, rows: DataFrame) -> str:
        """One run, its frequent keys in a part of their own."""
        self._written += 1
        path = f"{self.folder}/runs/run={self._written}"
        rows.select("h1", "h2", "n", (F.col("n") >= self.min_docs).alias("frequent")).sortWithinPartitions(
            "frequent", "h1", "h2").write.partitionBy("frequent").parquet(path)
        return path

    def _remove(self, paths: list[str]) -> None:
        for path in paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def frequent(self) -> DataFrame:
        return self._read(self.frequent_runs, True)

    def _others(self, counts: DataFrame) -> DataFrame:
        """Keys not yet found frequent."""
        return counts.join(self.frequent(), ["h1", "h2"], "left_anti") if self.frequent_runs else counts

    def add(self, counts: DataFrame) -> None:
        """Add a batch of (h1, h2, n), one row per key of the batch."""
        self.anti_joins += bool(self.frequent_runs)
        self.levels[0].append(self._keep(self._others(counts)))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
                self.merges.append(0)
            merged, self.levels[level] = self.levels[level], []
            self.levels[level + 1].append(self._merge(merged))
            self.merges[level] += 1
            level += 1

    def _keep(self, rows: DataFrame) -> str:
        path = self._write(rows)
        self.frequent_runs.append(path)
        if len(self.frequent_runs) > self.fanout:
            old = self.frequent_runs
            self.frequent_runs = [self._write(self._read(old, True))]
            self._remove([f"{p}/frequent=true" for p in old])
        return path

    def _merge(self, paths: list[str]) -> str:
        """One run of several. Keys found frequent since are left out: older runs may still hold some of their lines."""
        run = self._keep(self._others(self._read(paths, False).groupBy("h1", "h2").agg(F.sum("n").alias("n"))))
        self._remove([f"{p}/frequent=false" for p in paths])
        return run

    def close(self) -> DataFrame:
        """Merge all runs and return the frequent keys (h1, h2, n), each once; n counts up to when it got frequent.

        The result reads stored runs: take it before adding more.
        """
        left = [p for level in self.levels for p in level]
        if len(left) > 1:
            self.levels = [[], [self._merge(left)]]
        return self.frequent()


def _row_key(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_text_hash")]


def distinct_line_hashes(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(_id, _text_hash, h1, h2): the different line keys of each document."""
    keys = docs.select(*_row_key(docs, doc_id, text), F.explode(lines_of(F.col(text))).alias("_line"))
    keys = keys.select("_id", "_text_hash", line_key(F.col("_line")).alias("_key"))
    keys = keys.filter(F.length("_key") >= max(1, min_chars))
    return keys.select("_id", "_text_hash", F.inline(F.array(key_hash(F.col("_key"))))).distinct()


#: Line hashes of a batch; a table of more than fanout squared such batches has more batches.
BATCH_LINES = 500_000_000
#: Files that a batch is stored in at most.
BATCH_FILES = 64


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10,
                min_chars: int = 1, batches: int | None = None, fanout: int = 4) -> DataFrame:
    """``docs`` with two more columns: kept_text without the frequent lines, n_lines and n_dropped.

    Lines of a document that has none of the frequent keys are left as they are, a null text is null. ``batches`` is by
    default one for BATCH_LINES different lines of documents, fanout squared at least; the result does not depend on it.
    """
    spark = docs.sparkSession
    hashes = stage(distinct_line_hashes(docs, doc_id, text, min_chars), "line-hashes")
    runs = LineRuns(spark, min_docs, fanout)
    if batches is None:
        batches = max(fanout * fanout, -(-hashes.count() // BATCH_LINES))
    counts = hashes.groupBy(F.pmod(F.xxhash64("_id", "_text_hash"), F.lit(batches)).cast("int").alias("_batch"), "h1", "h2").agg(
        F.count(F.lit(1)).alias("n"))
    path = f"{runs.folder}/batches"
    # without this, every task would write a file for every batch
    counts.repartition(F.col("_batch"), F.pmod("h1", F.lit(BATCH_FILES))).write.partitionBy("_batch").parquet(path)
    stored = spark.read.schema(RUN + ", _batch int").parquet(path)
    for batch in range(batches):
        runs.add(stored.filter(F.col("_batch") == batch).select("h1", "h2", "n"))
    frequent = runs.close().select("h1", "h2")
    hits = hashes.join(frequent, ["h1", "h2"]).groupBy("_id", "_text_hash").agg(
        F.collect_list(F.struct("h1", "h2")).alias("_hits"))
    hits = stage(hits, "line-hits")
    return _drop_lines(docs, hits, doc_id, text, min_chars)


def without_frequent_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """``docs`` with its own columns, the frequent lines taken out of ``text``."""
    own, back = aside(docs, NEW)
    out = dedup_lines(own, doc_id, text, **more).withColumn(text, F.col("kept_text"))
    return out.select(*own.columns).withColumnsRenamed(back)


def _drop_lines(docs: DataFrame, hits: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    kept = [c for c in docs.columns if c.lower() not in NEW]
    h, i, t, k, n = (free_name(docs, x) for x in ("_hits", "_hit_id", "_hit_text", "_kept", "_th"))
    hits = hits.select(F.col("_id").alias(i), F.col("_text_hash").alias(t), F.col("_hits").alias(h))
    docs = docs.withColumn(n, F.xxhash64(F.col(text)))
    joined = docs.join(hits, F.col(doc_id).eqNullSafe(F.col(i)) & (F.col(n) == F.col(t)), "left")
    lines = lines_of(F.col(text))

    def stays(line):
        key = line_key(line)
        return (F.length(key) < max(1, min_chars)) | ~F.array_contains(F.col(h), key_hash(key))

    joined = joined.withColumn(k, F.when(F.col(h).isNotNull(), F.filter(lines, stays)))
    n_lines = F.size(lines)
    return joined.select(
        *kept,
        F.when(F.col(k).isNull(), F.col(text)).otherwise(F.array_join(F.col(k), "\n")).alias("kept_text"),
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col(k).isNull(), F.lit(0)).otherwise(n_lines - F.size(F.col(k))).cast("long").alias("n_dropped"))
