"""Mixing sources to target weights by temperature.

The token share of each source is raised to an exponent and normalised: 1 keeps the shares, 0 makes them
equal. The exponent is found by bisection, either for a target entropy of the weights or as the largest
flattening whose repetition of any source stays within a limit. Each source then gets its share of the
token budget: whole passes over all its documents, and a last, partial pass.

A pass is a block permutation. The blocks of a source are a hash of its documents, as many as keep a
block near ``block_tokens``; they are ordered by a hash of seed, pass and block, documents within a block
by a hash of seed, pass and document. The partial pass takes documents in that order while the budget
lasts. ``mix_pos``, the share of its source's budget used before a copy, interleaves the sources when sorted by.

Sums over sources and blocks stay in Spark; the driver sees a few numbers per bisection step. Blocks are
summed in two levels, so no task holds all the blocks of a hot source.

Definitions: tokens are the words of a text (runs without white space); null and empty texts have none
and are passed over, so are empty tables; a null source is a source; repeated rows are taken as often as
they occur, in the same place of the order.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .text import SPACES

SLICES = 16


def word_count(text: Column) -> Column:
    """Words of a text; white space becomes blanks first, so that one split is enough."""
    flat = F.translate(text, SPACES, " " * len(SPACES))
    return F.size(F.filter(F.split(flat, " ", -1), lambda w: w != "")).cast("long")


def _entropy(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Entropy in nats of the weights at each exponent; ``shares`` has the column ``share``."""
    aggs = []
    for i, a in enumerate(exponents):
        p = F.pow("share", F.lit(a))
        aggs += [F.sum(p).alias(f"z{i}"), F.sum(p * F.log("share") * a).alias(f"e{i}")]
    row = shares.agg(*aggs).first()
    return [log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"] for i in range(len(exponents))]


def _repetition(shares: DataFrame, exponents: list[float]) -> list[float]:
    """Largest weight over share, that is passes over a source per budget of one corpus."""
    aggs = []
    for i, a in enumerate(exponents):
        aggs += [F.sum(F.pow("share", F.lit(a))).alias(f"z{i}"),
                 F.max(F.pow("share", F.lit(a)) / F.col("share")).alias(f"m{i}")]
    row = shares.agg(*aggs).first()
    return [row[f"m{i}"] / row[f"z{i}"] for i in range(len(exponents))]


def find_exponent(shares: DataFrame, entropy: float | None = None, repetition: float | None = None,
                  steps: int = 6, digits: int = 6) -> float:
    """Exponent in [0, 1] by bisection, ``SLICES`` intervals at a time so that few jobs are needed.

    Both entropy and repetition fall as the exponent grows, so the answer is the largest exponent
    with at least that ``entropy``, or the least one within ``repetition``. Unreachable targets give 0 or 1.
    """
    if (entropy is None) == (repetition is None):
        raise ValueError("give either a target entropy or a repetition limit")
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        grid = [lo + (hi - lo) * i / SLICES for i in range(SLICES + 1)]
        if entropy is not None:
            above = [h >= entropy for h in _entropy(shares, grid)]
        else:
            above = [r > repetition for r in _repetition(shares, grid)]
        k = sum(above)  # above is true up to some place, then false
        if k == 0:
            hi = lo = grid[0]
            break
        if k == len(grid):
            hi = lo = grid[-1]
            break
        lo, hi = grid[k - 1], grid[k]
    return round(lo if entropy is not None else hi, digits)


def order_hash(*parts: Column) -> Column:
    """A permutation key that other SQL engines can reproduce: the md5 of the parts joined by |."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text",
        entropy_share: float | None = 0.98, repetition: float | None = None, budget_share: float = 1.0,
        block_tokens: int = 200_000, seed: int = 7) -> DataFrame:
    """One row per copy taken: doc_id, source, n_tokens, pass (from 0), weight and mix_pos.

    ``entropy_share`` is the target entropy as a share of that of equal weights, ``budget_share`` the
    token budget as a share of all tokens.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       word_count(F.col(text)).alias("n_tokens"))
    rows = stage(rows.filter(F.col("n_tokens") > 0), "mix-tokens")
    totals = stage(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    whole = totals.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not whole["t"]:
        plan_schema = "doc_id {}, source string, n_tokens long, pass long, weight double, mix_pos double"
        return spark.createDataFrame([], plan_schema.format(rows.schema["doc_id"].dataType.simpleString()))
    total = int(whole["t"])
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(total)))
    if repetition is not None:
        exponent = find_exponent(shares, repetition=repetition)
    else:
        exponent = find_exponent(shares, entropy=entropy_share * log(whole["n"])) if whole["n"] > 1 else 1.0
    norm = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0]
    plan = shares.withColumn("weight", F.round(F.pow("share", F.lit(exponent)) / F.lit(norm), 9))
    plan = plan.withColumn("budget", F.floor(F.col("weight") * F.lit(budget_share * total)).cast("long"))
    plan = plan.withColumn("full", F.floor(F.col("budget") / F.col("tokens")).cast("long"))
    plan = plan.withColumn("blocks", F.ceil(F.col("tokens") / F.lit(block_tokens)).cast("long"))
    plan = stage(plan.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")), "mix-plan")
    return realise(rows, plan, seed)


def realise(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Copies of ``rows`` (doc_id, source, n_tokens) that fill the budgets of ``plan``."""
    p = plan.withColumnRenamed("source", "_source")
    placed = rows.join(p, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # the same document is in the same block in every pass
    spot = F.conv(F.substring(order_hash(F.lit(seed), F.col("doc_id")), 1, 12), 16, 10).cast("long")
    placed = placed.withColumn("block", spot % F.col("blocks"))
    last = F.when(F.col("rest") > 0, F.col("full")).otherwise(F.col("full") - 1)
    copies = placed.withColumn("pass", F.explode(F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last))))
    block_order = order_hash(F.lit(seed), F.col("source"), F.col("pass"), F.col("block"))
    by_block = copies.groupBy("source", "pass", "block").agg(F.sum("n_tokens").alias("block_sum"))
    starts = block_starts(by_block.withColumn("block_key", block_order))
    starts = stage(starts, "mix-blocks").withColumnsRenamed({"source": "_s", "pass": "_p", "block": "_b"})
    copies = copies.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p"))
                         & (F.col("block") == F.col("_b")))
    partial = F.col("pass") == F.col("full")
    copies = copies.filter(~partial | (F.col("block_start") < F.col("rest")))
    doc_key = order_hash(F.lit(seed), F.col("pass"), F.col("doc_id"))
    w = Window.partitionBy("source", "pass", "block").orderBy("doc_key", "doc_id", "n_tokens").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n_tokens").over(w), F.lit(0))
    copies = copies.withColumn("doc_key", doc_key).withColumn("before", F.col("block_start") + inside)
    copies = copies.filter(~partial | (F.col("before") < F.col("rest")))
    used = (F.col("pass") * F.col("tokens") + F.col("before")) / F.col("budget")
    return copies.select("doc_id", "source", "n_tokens", "pass", "weight", F.round(used, 9).alias("mix_pos"))


def block_starts(blocks: DataFrame) -> DataFrame:
    """(source, pass, block, block_start): tokens of the blocks before, summed in two levels of 4096 groups."""
    groups = blocks.withColumn("grp", F.substring("block_key", 1, 3))
    sums = groups.groupBy("source", "pass", "grp").agg(F.sum("block_sum").alias("grp_sum"))
    w = Window.partitionBy("source", "pass").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("grp_start", F.coalesce(F.sum("grp_sum").over(w), F.lit(0)))
    sums = sums.withColumnsRenamed({"source": "_s", "pass": "_p", "grp": "_g"})
    w = Window.partitionBy("source", "pass", "grp").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    inner = groups.withColumn("inner", F.coalesce(F.sum("block_sum").over(w), F.lit(0)))
    joined = inner.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pass") == F.col("_p")) & (F.col("grp") == F.col("_g")))
    return joined.select("source", "pass", "block", (F.col("grp_start") + F.col("inner")).alias("block_start"))
