"""Grouping spelling variants: words one edit apart, found by blocked Gram matrices of their letter counts.

Spark counts the words of all texts. Words lie in blocks of one length and equal numbers of letters of four groups; one
inserted, deleted or replaced letter changes the length by one at most and two of these numbers by one at most, so a
word meets its own block and a fixed number of adjacent ones. A block of many letters is dealt into parts by hash, and
each pair of parts is one unit of work. In a unit, the products of letter counts (a Gram matrix, by NumPy) give
all squared distances: an edit leaves two words at 2 if they have one length, else at 1. The pairs kept are then
compared letter by letter.

A word's form is its near word of largest count, ties to the smallest in code-point order, if that is at least ``ratio``
times as frequent. Forms are followed to the last by doubling steps.

Definitions: a null text has no words. A null id is the empty text where ids are hashed. Rows count as often as they
occur. Words are runs of A-Z, a-z and U+00C0 to U+00FF, so each letter is one byte of Latin-1.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .text import LOWER, UPPER, small_batches

RUN = "[A-Za-zÀ-ÿ]"
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
HELD = 500_000  # words that a task counts before it hands them on
PART_BYTES = 1 << 16  # letters of a part of a block
#: Letters by group: frequent vowels and consonants are set apart; the rest is told by the length.
GROUPS = ("aeàáâäèéêë", "ioru", "nst", "lmcdp")


def count_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = 7, least_count: int = 2,
                dropped_of: int = 31) -> DataFrame:
    """(word, n) of all runs of letters, A-Z lower-cased.

    A run of which ``dropped_of`` divides the crc32 of ``<id>:<run>`` loses the letter at that number modulo its length;
    0 leaves all as they are.
    """
    find = re.compile(RUN + "{%d,}" % least_letters).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                start = zlib.crc32(f"{name or ''}:".encode())
                for run, n in Counter(find(raw.translate(TO_LOWER).decode())).items():
                    if dropped_of:
                        h = zlib.crc32(run.encode(), start)
                        if h % dropped_of == 0:
                            run = run[:h % len(run)] + run[h % len(run) + 1:]
                            if len(run) < least_letters:
                                continue
                    total[run] += n
                if len(total) > HELD:
                    yield rows()
                    total.clear()
        if total:
            yield rows()

    small_batches(docs)
    found = docs.select(F.col(doc_id).cast("string"), F.col(text)).filter(F.col(text).isNotNull()).mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _numbers() -> list[Column]:
    """Letters of each group in a word."""
    return [F.length("word") - F.length(F.translate(F.col("word"), letters, "")) for letters in GROUPS]


def _moves() -> list[tuple[int, ...]]:
    """Changes of (length, numbers) that one edit may bring, one of each pair of opposite ones.

    A replaced letter leaves one group, or the rest, for another; an inserted one adds to one group or to the rest.
    """
    k = len(GROUPS)
    one = lambda i: tuple(int(i == j) for j in range(k))
    none = one(k)
    swaps = {tuple(a - b for a, b in zip(x, y)) for x in (*map(one, range(k)), none) for y in (*map(one, range(k)), none)}
    return [(0, *m) for m in sorted(swaps) if m >= none] + [(1, *m) for m in sorted({*map(one, range(k)), none})]


def _units(words: DataFrame, part_bytes: int) -> DataFrame:
    """(unit, word, n, side) of each pair of parts that may hold near words: side 0 meets side 1, in a unit of one part
    every word meets the others."""
    keyed = words.select("word", "n", F.array(F.length("word"), *_numbers()).alias("block"))
    sizes = keyed.groupBy("block").agg(F.count(F.lit(1)).alias("_rows")).select(
        "block", F.ceil(F.col("_rows") * F.greatest(F.element_at("block", 1), F.lit(64)) / part_bytes).cast("int").alias("parts"))
    moves = F.array(*[F.array(*map(F.lit, m)) for m in _moves()])
    ahead = F.transform(moves, lambda m: F.zip_with("block", m, lambda a, b: a + b))
    # (lower block, upper block, parts of both), for blocks that exist
    pairs = sizes.select(F.col("block").alias("low"), F.col("parts").alias("low_parts"), F.explode(ahead).alias("block")).join(
        sizes.withColumnRenamed("parts", "high_parts"), "block").withColumnRenamed("block", "high")
    pairs = stage(pairs, "block-pairs")
    sides = pairs.select(F.col("low").alias("block"), "low", "high", F.lit(0).alias("side"), F.col("low_parts").alias("own"),
                         F.col("high_parts").alias("other"))
    sides = sides.unionByName(pairs.filter("low != high").select(
        F.col("high").alias("block"), "low", "high", F.lit(1).alias("side"), F.col("high_parts").alias("own"), F.col("low_parts").alias("other")))
    met = keyed.join(sides, "block").withColumn("part", F.pmod(F.xxhash64("word"), F.col("own")).cast("int"))
    met = met.withColumn("across", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    inner = F.col("low") == F.col("high")
    # within a block: parts i < j meet as sides 0 and 1, and each part meets itself
    side = F.when(inner & (F.col("part") > F.col("across")), 1).otherwise(F.col("side"))
    first = F.when(side == 0, F.col("part")).otherwise(F.col("across"))
    second = F.when(side == 0, F.col("across")).otherwise(F.col("part"))
    unit = F.xxhash64("low", "high", first, second)
    alone = inner & (F.col("part") == F.col("across"))
    return met.select(unit.alias("unit"), "word", "n", side.cast("int").alias("side"), alone.alias("alone"))


def _letters(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Padded letters and letter counts of words."""
    width = max(map(len, words))
    letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    # sums of squares stay below 2**24, where float32 is exact, unless a word is very long
    counts = np.zeros((len(words), 256), np.float32 if width < 2048 else np.float64)
    for i in range(width):
        counts[np.arange(len(words)), letters[:, i]] += 1
    return letters, counts[:, 1:]


def near_pairs(left: list[bytes], right: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all words one edit apart, of ``left`` against ``right`` or within ``left``, each pair once.

    Words of a side have one length; those of ``right`` have the same or one letter more.
    """
    a, x = _letters(left)
    b, y = (a, x) if right is None else _letters(right)
    used = np.flatnonzero(x.any(0) | y.any(0))
    x, y = x[:, used], y[:, used]
    found = []
    for at in range(0, len(a), 1024):
        part = x[at:at + 1024]
        distance = (part * part).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (part @ y.T)
        i, j = np.nonzero((distance > 0.5) & (distance < 2.5))
        found.append((i + at, j))
    i, j = (np.concatenate(v) for v in zip(*found))
    if right is None:
        i, j = i[i < j], j[i < j]
    la, lb = a.shape[1], b.shape[1]
    keep = []
    for at in range(0, len(i), 1 << 16):
        p, q = a[i[at:at + (1 << 16)]], b[j[at:at + (1 << 16)]]
        if la == lb:
            keep.append((p != q).sum(1) == 1)
        else:
            front = np.cumprod(p == q[:, :la], axis=1).sum(1)
            back = np.cumprod((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
            keep.append(front + back >= la)
    good = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[good], j[good]


def near_words(words: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(word, near, near_n): every word one edit from another, in both directions."""
    units = _units(words, part_bytes).repartition("unit").sortWithinPartitions("unit")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(rows: pa.Table) -> pa.RecordBatch:
            """Near words of whole units in order."""
            unit = rows.column("unit").to_numpy()
            side, alone = rows.column("side").to_numpy(), rows.column("alone").to_numpy(zero_copy_only=False)
            word = [w.encode("latin-1") for w in rows.column("word").to_pylist()]
            borders = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True])
            ones, others = [], []
            for begin, end in zip(borders[:-1], borders[1:]):
                at = np.arange(begin, end)
                l, r = at[side[begin:end] == 0], at[side[begin:end] == 1]
                if alone[begin]:
                    i, j = near_pairs([word[k] for k in at], None)
                    l = r = at
                elif len(l) and len(r):
                    i, j = near_pairs([word[k] for k in l], [word[k] for k in r])
                else:
                    continue
                ones.append(l[i])
                others.append(r[j])
            one, other = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (ones, others))
            one, other = pa.array(np.r_[one, other]), pa.array(np.r_[other, one])
            return pa.RecordBatch.from_arrays(
                [c.combine_chunks() for c in (rows.column("word").take(one), rows.column("word").take(other), rows.column("n").take(other))],
                ["word", "near", "near_n"])

        pending = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if pending is None else pa.concat_tables([pending, pa.Table.from_batches([batch])])
            unit = table.column("unit").to_numpy()
            whole = int(np.argmax(unit == unit[-1])) if len(unit) else 0  # the last unit may go on
            if whole:
                yield of(table.slice(0, whole).combine_chunks())
            pending = table.slice(whole)
        if pending is not None and len(pending):
            yield of(pending.combine_chunks())

    return units.select("unit", "word", "n", "side", "alone").mapInArrow(find, "word string, near string, near_n long")


def forms(words: DataFrame, ratio: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n) of (word, n)."""
    best = near_words(words, part_bytes).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    n = -F.col("best.less")
    takes = n >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                         F.when(takes, F.col("best.near")).alias("form"), F.when(takes, n).alias("form_n"))


def variant_groups(words: DataFrame, ratio: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """``forms`` with ``root``, the last of a word's chain of forms, the word itself if it has none.

    Counts grow by ``ratio`` along a chain, so a chain of counts that fit a long is short and each round halves it.
    """
    words = stage(words.select("word", "n"), "word-counts")
    found = stage(forms(words, ratio, part_bytes), "word-forms")
    ahead = stage(found.filter("form is not null").select("word", F.col("form").alias("root")), "word-roots")
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = ahead.join(step, "root", "left")
        if joined.filter("_next is not null").limit(1).count() == 0:
            break
        ahead = stage(joined.select("word", F.coalesce("_next", "root").alias("root")), "word-roots")
    return found.join(ahead, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
