"""Phrases that are more than the sum of their parts, mined from stripes.

A stripe belongs to a prefix of words and counts, associatively, the words that follow it; the end of a piece and rare
followers make one more element, the rest. Tasks build stripes of their texts, Spark adds those of equal prefixes element
by element. A merged stripe then gives three things: its elements are the counts of the prefix's extensions by a
word, its total is the count of the prefix itself, and its largest element is the highest count of any extension to the
right (for those to the left, the elements of all stripes are asked by their last words).

Which prefixes and followers can be frequent at all is found first, length by length: phrases are counted by 40
bits of their hash, which takes tasks about two bytes a phrase, and only phrases whose two parts of one word less have passed are
counted. Phrases that share a hash count together, so no frequent one is missed; the stripes then tell phrases apart by
their words, and their counts are exact. The hashes that pass go to tasks as sorted arrays, at most ``held`` of a length at once;
of a length with more, the texts are read once for each share of the prefixes.

Definitions: a null text is empty, a null language is ``und``; repeated rows count. Within a language, a document's pieces
end at any of ``. , ; : ! ?`` and at line ends; words are what blanks and tabs leave of them, A-Z lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .text import small_batches
from .words import IS_SPACE, LOWERED, PLACE, U, mixed, text_slices, words_of

#: What ends a piece becomes a line feed, all else but blank and tab stays a letter.
IN_PIECES = LOWERED.copy()
IN_PIECES[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 10
HELD_HASHES = 4_000_000
HELD_STRIPES = 400_000
TOP_SALTS = 64
PART = 1_000_000  # occurrences of a prefix that share a part of its stripe
FIRST_PARTS = 64  # parts of the stripe of the empty prefix
BUNDLES = 256  # rows, at least, in which a task hands on its stripes
RANGES = 1024  # ranges, at least, that deal the counted hashes to tasks
STRIPES = "bundle int, stripes array<struct<lang:string,prefix:string,part:int,nexts:array<string>,ns:array<long>>>"


class Pieces:
    """Words of some texts, numbered by piece; the words as one Arrow array."""

    def __init__(self, part: pa.Array, langs: np.ndarray):
        words = words_of(part, IN_PIECES)
        breaks = np.cumsum(words.data == 10)
        text = np.repeat(np.arange(len(words)), words.counts())
        self.hash = words.hash
        self.n = len(self.hash)
        piece = breaks[words.start] + text  # both grow along the texts
        last = np.flatnonzero(np.r_[piece[1:] != piece[:-1], np.ones(min(1, self.n), bool)])
        here = np.arange(self.n)
        self.left = last[np.searchsorted(last, here)] - here + 1  # words of the piece from here on
        self.lang = langs[text]
        ends = np.r_[0, np.cumsum(words.end - words.start)].astype(np.int32)
        self.words = pa.StringArray.from_buffers(self.n, pa.py_buffer(ends), pa.py_buffer(words.data[~IS_SPACE[words.data]]))

    def grams(self, k: int) -> np.ndarray:
        """64-bit hash of the k words from each word on, mixed with the language; meaningless across borders."""
        total = mixed(self.lang.astype(U) + U(k << 8))
        total = np.broadcast_to(total, self.n).copy()
        for i in range(min(k, self.n)):
            total[:self.n - i] += self.hash[i:] * PLACE[i]
        return mixed(total)

    def short(self, k: int, bits: int) -> np.ndarray:
        """The leading bits of ``grams``, as signed numbers."""
        return (self.grams(k) >> U(64 - bits)).view(np.int64)

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The k words from each place on, joined with blanks."""
        if k == 0:
            return pa.array([""] * len(at), pa.string())
        parts = [self.words.take(pa.array(at + i)) for i in range(k)]
        return pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]


def _lang_hash(names: list[str]) -> np.ndarray:
    """A number for each language that is the same in all tasks."""
    of = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in set(names)}
    return np.array([of[x] for x in names], np.int64)


@dataclass
class Passed:
    """Hashes of phrases of one length that may be frequent, sorted, with the counts of their hashes."""

    grams: np.ndarray
    counts: np.ndarray

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(has passed, count) of each hash."""
        if not len(self.grams):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.searchsorted(self.grams, key)
        at[at == len(self.grams)] = 0
        return self.grams[at] == key, self.counts[at]


@dataclass
class Share:
    """Some prefixes of one length, and extensions of theirs that passed.

    ``prefixes`` is None for the empty prefix. ``all_prefixes`` tells that these are all of their length. Of ``slices`` of
    the extensions by their hash, this one is number ``own``: it has the places where a word follows whose extension is in the slice,
    number 0 also those where none follows, so each place is in one slice.
    """

    k: int
    prefixes: Passed | None
    longer: Passed | None = None
    all_prefixes: bool = True
    bits: int = 40
    own: int = 0
    slices: int = 1

    def sliced(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``places`` of the slice."""
        at, count, follows = self.places(pieces)
        if self.slices > 1:
            slice_of = np.where(follows, pieces.short(self.k + 1, self.bits)[at] % self.slices, 0)
            mine = slice_of == self.own
            at, count, follows = at[mine], count[mine], follows[mine]
        return at, count, follows

    def places(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, count of the prefix there, whether a word follows)."""
        at = np.flatnonzero(pieces.left >= self.k)
        if self.prefixes is None:
            return at, np.full(len(at), PART * (FIRST_PARTS - 1)), np.ones(len(at), bool)
        found, count = self.prefixes.find(pieces.short(self.k, self.bits)[at])
        at, count = at[found], count[found]
        return at, count, pieces.left[at] > self.k

    def extended(self, pieces: Pieces) -> np.ndarray:
        """Hashes of the extensions of prefixes here of which the last words have passed, too."""
        at, _, follows = self.places(pieces)
        at = at[follows]
        if self.prefixes is not None and self.all_prefixes:
            at = at[self.prefixes.find(pieces.short(self.k, self.bits)[at + 1])[0]]
        return pieces.short(self.k + 1, self.bits)[at]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pieces, dict[int, str]]]:
    """Slices of (text, lang) with the names of their languages."""
    for batch in batches:
        names = batch.column(1).to_pylist()
        langs = _lang_hash(names)
        name_of = dict(zip(langs.tolist(), names))
        for row, text in text_slices(batch.column(0)):
            pieces = Pieces(text, langs[row:row + len(text)])
            if pieces.n:
                yield pieces, name_of


def _partitions(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return key, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)


def passed(docs: DataFrame, share: Share, least: int) -> DataFrame:
    """(gram, n) of the hashes that extensions of the share's prefixes have ``least`` times or more together."""
    sent = docs.sparkSession.sparkContext.broadcast(share)
    ranges = min(1 << max(RANGES.bit_length() - 1, (4 * _partitions(docs)).bit_length()), 1 << share.bits)
    shift = np.int64(share.bits - ranges.bit_length() + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            key, n = _summed(held)
            borders = np.searchsorted(key, np.arange(ranges + 1, dtype=np.int64) << shift)
            spans = [(i, a, b) for i, (a, b) in enumerate(zip(borders[:-1], borders[1:])) if a < b]
            steps = np.diff(key, prepend=0)
            cuts = []
            for _, a, b in spans:  # differences, each byte in a row of its own, which compresses well
                step = steps[a:b].copy()
                step[0] = key[a]
                cuts.append(step.view(np.uint8).reshape(-1, 8).T.tobytes())
            return pa.RecordBatch.from_arrays([
                pa.array([i for i, _, _ in spans], pa.int32()), pa.array(cuts, pa.binary()),
                pa.array([np.minimum(n[a:b], 0xFFFFFFFF).astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for _, a, b in spans], pa.binary())],
                ["range", "keys", "counts"])

        for pieces, _ in _pieces(batches):
            held.append(np.unique(sent.value.extended(pieces), return_counts=True))
            if sum(len(k) for k, _ in held) > 4 * HELD_STRIPES:
                held = [_summed(held)]
                if len(held[0][0]) > 2 * HELD_STRIPES:
                    yield rows()
                    held = []
        if held and any(len(k) for k, _ in held):
            yield rows()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def out() -> pa.RecordBatch:
            key, n = _summed(parts)
            return pa.RecordBatch.from_arrays([pa.array(key[n >= least]), pa.array(n[n >= least])], ["gram", "n"])

        for batch in batches:
            for i, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if i != now and parts:
                    yield out()
                    parts = []
                now = i
                step = np.frombuffer(keys, np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()
                parts.append((np.cumsum(step), np.frombuffer(counts, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)))
                if len(parts) > 64:
                    parts = [_summed(parts)]
        if parts:
            yield out()

    small_batches(docs)
    dealt = docs.mapInArrow(count, "range int, keys binary, counts binary").repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(add, "gram long, n long")


class Held:
    """Stripe elements of a task, added up by hash until there are many, and handed on as parts of stripes."""

    def __init__(self, bundles: int):
        self.bundles = bundles
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]] = []

    def add(self, key: np.ndarray, n: np.ndarray, stripe: np.ndarray, part: np.ndarray, rows: pa.Table) -> bool:
        self.parts.append((key, n, stripe, part, rows))
        if sum(len(p[0]) for p in self.parts) > 2 * HELD_STRIPES:
            self._merge()
            return len(self.parts[0][0]) > HELD_STRIPES
        return False

    def _merge(self) -> None:
        key, n, stripe, part = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
        key, at, back = np.unique(key, return_index=True, return_inverse=True)
        rows = pa.concat_tables([p[4] for p in self.parts]).take(pa.array(at)).combine_chunks()
        self.parts = [(key, np.bincount(back, n).astype(np.int64), stripe[at], part[at], rows)]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._merge()
        if not self.parts or not len(self.parts[0][0]):
            return
        _, n, stripe, part, rows = self.parts.pop()
        bundle = (mixed(stripe + part.astype(U)) % U(self.bundles)).astype(np.int32)
        by = np.lexsort((part, stripe, bundle))
        stripe, part, bundle = stripe[by], part[by], bundle[by]
        first = np.flatnonzero(np.r_[True, (stripe[1:] != stripe[:-1]) | (part[1:] != part[:-1])])
        column = lambda name, at: rows.column(name).take(pa.array(by[at])).combine_chunks()
        ends = pa.array(np.r_[first, len(by)].astype(np.int32))
        stripes = pa.StructArray.from_arrays(
            [column("lang", first), column("prefix", first), pa.array(part[first].astype(np.int32)),
             pa.ListArray.from_arrays(ends, column("next", slice(None))), pa.ListArray.from_arrays(ends, pa.array(n[by]))],
            ["lang", "prefix", "part", "nexts", "ns"])
        own = bundle[first]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[new, len(own)].astype(np.int32)), stripes)
        whole = pa.RecordBatch.from_arrays([pa.array(own[new]), lists], ["bundle", "stripes"])
        for at in range(0, len(whole), 32):
            yield whole.slice(at, 32)


def stripes(docs: DataFrame, shares: list[Share]) -> DataFrame:
    """Bundles of stripes of (text, lang): those of the shares' prefixes, one or more of a prefix from each task.

    An empty follower is the rest of a stripe: ends of pieces, and words whose extension has not passed. A stripe is in parts
    by the hash of its followers, one for each ``PART`` of the prefix's count, so no part grows with a hot prefix.
    """
    sent = docs.sparkSession.sparkContext.broadcast(shares)
    bundles = max(BUNDLES, 4 * _partitions(docs))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(bundles)
        for pieces, name_of in _pieces(batches):
            for share in sent.value:
                k = share.k
                at, count, follows = share.sliced(pieces)
                if not len(at):
                    continue
                grams, longer = pieces.grams(k)[at], pieces.grams(k + 1)[at]
                follows = follows & share.longer.find(pieces.short(k + 1, share.bits)[at])[0]
                # elements: (prefix, next) where a word follows, else (prefix, rest)
                key = np.where(follows, mixed(longer + U(k)), mixed(mixed(grams) + U(k)))
                key, first, n = np.unique(key, return_index=True, return_counts=True)
                place, more = at[first], follows[first]
                ahead = np.minimum(place + k, pieces.n - 1)
                part = np.where(more, (pieces.hash[ahead] >> U(33)).astype(np.int64), 0) % (1 + count[first] // PART)
                rows = pa.table({
                    "lang": pa.array([name_of[x] for x in pieces.lang[place].tolist()], pa.string()),
                    "prefix": pieces.phrases(place, k), "next": pc.if_else(pa.array(more), pieces.words.take(pa.array(ahead)), "")})
                if held.add(key, n, grams[first], part, rows):
                    yield from held.rows()
        yield from held.rows()

    small_batches(docs)
    return docs.mapInArrow(build, STRIPES)


def merged(bundles: DataFrame, least: int) -> DataFrame:
    """Stripes (lang, prefix, next, n) added up element by element; elements below ``least`` join the rest.

    The parts of one stripe meet in a task, which adds them as they are, so no row is made of an element of a task.
    """
    keys = ["lang", "prefix", "next"]

    def summed(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(keys).aggregate([("n", "sum")]).rename_columns([*keys, "n"])

    def elements(stripes: pa.Array) -> pa.Table:
        lang, prefix, _, nexts, ns = stripes.flatten()
        of = pc.list_parent_indices(nexts)
        return pa.table([lang.take(of), prefix.take(of), nexts.flatten(), ns.flatten()], [*keys, "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def out() -> list[pa.RecordBatch]:
            whole = summed(parts)
            stays = pc.and_(pc.greater_equal(whole["n"], least), pc.not_equal(whole["next"], ""))
            rest = whole.filter(pc.invert(stays))
            rest = rest.set_column(2, "next", pa.nulls(len(rest), pa.string()))
            return pa.concat_tables([whole.filter(stays), summed([rest])]).combine_chunks().to_batches(max_chunksize=50_000)

        for batch in batches:
            for i in range(len(batch)):
                if batch.column(0)[i].as_py() != now and parts:
                    yield from out()
                    parts = []
                now = batch.column(0)[i].as_py()
                parts.append(elements(batch.column(1)[i].values))
                if sum(map(len, parts)) > 2 * HELD_STRIPES:
                    parts = [summed(parts)]
        if parts:
            yield from out()

    met = bundles.repartition("bundle").sortWithinPartitions("bundle")
    return met.mapInArrow(add, "lang string, prefix string, next string, n long").groupBy(*keys).agg(F.sum("n").alias("n"))


def totals(stripe: DataFrame) -> DataFrame:
    """(lang, phrase, f, above): each prefix's count, and its most frequent extension's if that is frequent."""
    return stripe.groupBy("lang", F.col("prefix").alias("phrase")).agg(
        F.sum("n").alias("f"), F.max(F.when(F.col("next").isNotNull(), F.col("n"))).alias("above"))


def _taken(rows: DataFrame) -> Passed:
    table = rows.toArrow()
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    by = np.argsort(gram)
    return Passed(gram[by], n[by])


def candidates(docs: DataFrame, longest: int, least: int, held: int, bits: int = 40) -> list[tuple[Share, DataFrame]]:
    """Shares of the prefixes of each length from 0 to ``longest`` - 1 words, and the stored (gram, n) of their extensions."""
    out, level = [], [Share(0, None, bits=bits)]
    for k in range(longest):
        kept = [stage(passed(docs, share, least), f"passed-{k + 1}") for share in level]
        out += zip(level, kept)
        rows = kept[0]
        for more in kept[1:]:
            rows = rows.unionByName(more)
        rows = rows.groupBy("gram").agg(F.sum("n").alias("n")) if len(kept) > 1 else rows
        of = max(1, -(-rows.count() // held))
        if k + 1 < longest:
            level = [Share(k + 1, _taken(rows.filter(F.pmod("gram", F.lit(of)) == i)), None, of == 1, bits) for i in range(of)]
    return out


def slices(found: list[tuple[Share, DataFrame]], held: int) -> Iterator[list[Share]]:
    """Shares with their extensions, at most about ``held`` of a share at a time, in lists for one reading of the texts each."""
    together = []
    for share, rows in found:
        of = max(1, -(-rows.count() // held))
        parts = (replace(share, longer=_taken(rows.filter(F.pmod("gram", F.lit(of)) == i)), own=i, slices=of) for i in range(of))
        if of == 1 and share.all_prefixes:
            together += parts
        else:
            yield from ([part] for part in parts)
    if together:
        yield together


def mine(docs: DataFrame, longest: int = 5, least: int = 100, held: int = HELD_HASHES, bits: int = 40) -> DataFrame:
    """Merged stripes (lang, prefix, next, n) of all prefixes of up to ``longest`` - 1 words of (text, lang) that may be frequent."""
    out = None
    for shares in slices(candidates(docs, longest, least, held, bits), held):
        part = stage(merged(stripes(docs, shares), least), "stripes")
        out = part if out is None else out.unionByName(part)
    return out


def _big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, top: int = 2000,
                 cover: int = 100, held: int = HELD_HASHES, bits: int = 40) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases.

    A phrase of count a, cut in two of counts l and r, scores floor(1000 a n / (l r)), n being the language's words; the
    lowest cut counts, the first of equals. A phrase that a longer frequent one holds, with ``cover`` per cent of its
    count, is left out.
    """
    docs = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"))
    found = mine(docs, longest, least, held, bits)
    total = found.filter("prefix = ''").groupBy("lang").agg(F.sum("n").alias("n"))
    phrases = stage(found.filter("prefix != '' and next is not null").select(
        "lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.split(F.concat_ws(" ", "prefix", "next"), " ").alias("w"),
        F.col("n").alias("a")), "phrases")
    prefixes = stage(totals(found.filter("prefix != ''")), "prefixes")
    # what extends a phrase to the left: the elements of all stripes by their last words
    left = phrases.groupBy("lang", F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " ").alias("phrase")).agg(F.max("a").alias("before"))
    open_ = phrases.join(prefixes.select("lang", "phrase", "above"), ["lang", "phrase"], "left").join(left, ["lang", "phrase"], "left")
    held_by = F.greatest("above", "before")
    open_ = open_.filter(held_by.isNull() | (_big(held_by) * 100 < _big("a") * cover))
    cuts = open_.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("second"))
    part = lambda name, n: prefixes.select("lang", F.col("phrase").alias(name), F.col("f").alias(n))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("second", "r"), ["lang", "second"]).join(total, "lang")
    scored = scored.withColumn("over", _big("a") * _big("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("under", _big("l") * _big("r"))
    best = scored.groupBy("lang", "phrase").agg(
        F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("best"), F.max("a").alias("a"), F.max("n").alias("n"))
    order = [F.desc("best.score"), F.desc("a"), F.asc("phrase")]
    # the first of each share of a language, then of the language
    some = Window.partitionBy("lang", "salt").orderBy(*order)
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(TOP_SALTS))).withColumn("rank", F.row_number().over(some)).filter(
        F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"),
                         F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
