"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage


SALTS = 16


def _least_neighbour(directed: DataFrame) -> DataFrame:
    """Edges with the least of their node ``u`` and its neighbours; a hot node's edges are divided among salts."""
    least = directed.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = directed.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["u", "salt"]).drop("salt")


def _is_finished(e: DataFrame) -> bool:
    """Whether every node has one edge at most, and that to a node without one: a forest of stars."""
    ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    nodes = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return nodes.filter("out > 1 OR (out = 1 AND into = 1)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for every node of ``edges`` (a, b: longs).

    Each round halves paths about; edges only ever point to smaller nodes, so a hot centre is one row per
    neighbour. Rounds end with a forest of stars. No edge leaves Spark.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    e = stage(e, "edges")
    while not _is_finished(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u != v").distinct(), "edges")
        tied = _least_neighbour(large)
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v")))
        e = stage(small.filter("u != v").distinct(), "edges")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
