"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH, verified by edit distance.

Texts are words (A-Z lower-cased, ASCII punctuation as white space). Item-sized windows of a document are
embedded by random walks: step j shows the word under a pointer, which moves on if a random bit of (j,
word) says so. Two texts some edits apart run in step again soon after each edit, so their walks agree in
most places. Tables of a few sampled places each find windows that agree with an item in one table at
least; the number of tables follows from the recall wanted. What is found is verified: the least number of
word edits between the item and any stretch of the document around the window, at most ``edits`` per item word.

Windows are placed only where an item's word runs occur: k edits destroy at most g k of an item's runs of g
words, so g is chosen per item such that two or more must be left if the item has that many words. Where
fewer occur there is nothing within the limit.

Items are taken in blocks of ``ITEM_BLOCK``, one pass over the documents each, all in one stage without a shuffle.
Null and empty texts and items without a word match nothing; repeated items are all named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import aside, small_batches
from .words import PLAIN, U, mixed, text_slices, windows, words_of

ITEM_BLOCK = 20_000
WALKS = 8
PLACES = 3
WINDOWS_AT_ONCE = 4096
FOUND = ("item_ids", "item_edits")
PAD = U(0x0123456789ABCDEF)


@dataclass(frozen=True)
class Limits:
    edits: float = 0.2
    recall: float = 0.99

    def most(self, words: int) -> int:
        return int(self.edits * words)

    def gram(self, words: int) -> tuple[int, int]:
        """(g, least number of the item's g-word runs left after the edits allowed)."""
        for g in (3, 2):
            left = words - g + 1 - g * self.most(words)
            if left >= 2:
                return g, 2
        return 1, max(1, min(2, words - self.most(words)))

    def tables(self) -> int:
        """Tables for the recall if an edit costs three places of a walk on the average."""
        agree = max(0.1, 1 - 3 * self.edits) ** PLACES
        return ceil(log(1 - self.recall) / log(1 - agree))


def embed(words: np.ndarray, lengths: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """Walks over the rows of ``words`` (rows x most words), ``steps`` symbols each."""
    keys = np.random.Generator(np.random.PCG64([77, walk])).integers(1, 2**63, steps, dtype=U)
    rows = np.arange(len(words))
    at = np.zeros(len(words), np.int64)
    out = np.empty((len(words), steps), U)
    for j in range(steps):
        inside = at < lengths
        symbol = np.where(inside, words[rows, np.minimum(at, words.shape[1] - 1)], PAD)
        out[:, j] = symbol
        at += (mixed(symbol ^ keys[j]) >> U(63)).astype(np.int64)
    return out


class Items:
    """Items of one block with their seeds and hash tables; made on the driver, read by the tasks."""

    def __init__(self, rows: list[tuple[int, str]], limits: Limits):
        self.limits = limits
        found = words_of(pa.array([t for _, t in rows], pa.string()), PLAIN)
        lengths = found.counts()
        keep = np.flatnonzero(lengths > 0)
        self.ids = np.array([rows[i][0] for i in keep], np.int64)
        self.words = [found.hash[found.first[i]:found.first[i + 1]] for i in keep]
        self.length = lengths[keep].astype(np.int64)
        self.need = np.array([limits.gram(n)[1] for n in self.length], np.int64)
        gram, owner, place = [], [], []
        for i, w in enumerate(self.words):
            seeds = windows(w, limits.gram(len(w))[0])
            gram.append(seeds)
            owner.append(np.full(len(seeds), i))
            place.append(np.arange(len(seeds)))
        self.gram = np.concatenate(gram) if gram else np.zeros(0, U)
        order = np.argsort(self.gram, kind="stable")
        self.gram = self.gram[order]
        self.owner = np.concatenate(owner)[order] if gram else np.zeros(0, int)
        self.place = np.concatenate(place)[order] if gram else np.zeros(0, int)
        self.sizes = sorted({limits.gram(int(n))[0] for n in self.length})
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.gram & U(0xFFFFF)).astype(np.int64)] = True
        self.per_walk = ceil(limits.tables() / WALKS)
        # each table's sampled places, by length
        self.places = {}
        for n in np.unique(self.length):
            rng = np.random.Generator(np.random.PCG64([78, int(n)]))
            self.places[int(n)] = rng.integers(0, 3 * n, (WALKS, self.per_walk, PLACES))
        self.codes = self.sign(self._matrix(self.words), self.length, self.length) if len(keep) else np.zeros((0, 0), U)

    @staticmethod
    def _matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.full((len(rows), max(len(r) for r in rows)), PAD, U)
        for i, r in enumerate(rows):
            out[i, :len(r)] = r
        return out

    def sign(self, words: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One code per table of each row, with the tables of item length ``sizes``."""
        places = np.stack([self.places[int(n)] for n in sizes])
        codes = []
        for walk in range(WALKS):
            path = embed(words, lengths, walk, int(3 * sizes.max()))
            seen = np.take_along_axis(path, places[:, walk].reshape(len(path), -1), 1)
            seen = seen.reshape(len(path), self.per_walk, PLACES)
            total = np.zeros(seen.shape[:2], U)
            for p in range(PLACES):
                total = mixed(total + seen[:, :, p])
            codes.append(total)
        return np.concatenate(codes, 1)

    def seeds(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, index of the item's seed) for every seed in a text's word hashes."""
        where, which = [], []
        for g in self.sizes:
            grams = windows(hashes, g)
            at = np.flatnonzero(self.low[(grams & U(0xFFFFF)).astype(np.int64)])
            lo = np.searchsorted(self.gram, grams[at])
            n = np.searchsorted(self.gram, grams[at], "right") - lo
            where.append(np.repeat(at, n))
            which.append(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.concatenate(where), np.concatenate(which)

    def place_windows(self, found) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, item, first word) of the windows of a slice that its seeds ask for."""
        nothing = np.zeros(0, np.int64)
        if not len(found.hash) or not len(self.gram):
            return nothing, nothing, nothing
        at, seed = self.seeds(found.hash)
        text = np.searchsorted(found.first, at, "right") - 1
        item = self.owner[seed]
        size = np.array([self.limits.gram(int(n))[0] for n in self.length])[item] if len(item) else nothing
        inside = at + size <= found.first[text + 1]
        text, item, seed, at = text[inside], item[inside], seed[inside], at[inside]
        pair = text * len(self.ids) + item
        _, back = np.unique(pair, return_inverse=True)
        # different seeds of the item in this text
        different = np.unique(np.stack([back, self.place[seed]], 1), axis=0)[:, 0] if len(back) else nothing
        enough = np.bincount(different, minlength=back.max() + 1 if len(back) else 0)[back] >= self.need[item] if len(back) else back.astype(bool)
        text, item, start = text[enough], item[enough], (at - self.place[seed])[enough]
        last = np.maximum(found.first[text + 1] - self.length[item], found.first[text])
        start = np.clip(start, found.first[text], last)
        rows = np.unique(np.stack([text, item, start], 1), axis=0) if len(text) else np.zeros((0, 3), np.int64)
        return rows[:, 0], rows[:, 1], rows[:, 2]

    def agree(self, found, text: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which windows share a table's code with their item."""
        out = np.zeros(len(text), bool)
        for a in range(0, len(text), WINDOWS_AT_ONCE):
            part = slice(a, a + WINDOWS_AT_ONCE)
            n = self.length[item[part]]
            lengths = np.minimum(n, found.first[text[part] + 1] - start[part])
            columns = np.arange(n.max())
            at = np.minimum(start[part][:, None] + columns, len(found.hash) - 1)
            words = np.where(columns < lengths[:, None], found.hash[at], PAD)
            out[part] = (self.sign(words, lengths, n) == self.codes[item[part]]).any(1)
        return out

    def distance(self, found, text: int, item: int, start: int) -> int:
        """Least word edits between the item and a stretch of the text around the window."""
        words, spare = self.words[item], self.limits.most(int(self.length[item]))
        lo = max(int(found.first[text]), start - 2 * spare - 1)
        hi = min(int(found.first[text + 1]), start + len(words) + 2 * spare + 1)
        stretch = found.hash[lo:hi]
        place = np.arange(len(stretch) + 1)
        row = np.zeros(len(stretch) + 1, np.int64)
        for i, w in enumerate(words):
            new = np.empty_like(row)
            new[0] = i + 1
            new[1:] = np.minimum(row[:-1] + (stretch != w), row[1:] + 1)
            row = np.minimum.accumulate(new - place) + place
        return int(row.min())

    def matches(self, texts: pa.Array) -> list[dict[int, int]]:
        """For each text the items found and their edits."""
        out: list[dict[int, int]] = [{} for _ in range(len(texts))]
        for row, part in text_slices(texts):
            found = words_of(part, PLAIN)
            text, item, start = self.place_windows(found)
            if not len(text):
                continue
            good = self.agree(found, text, item, start)
            for t, i, s in zip(text[good], item[good], start[good]):
                here, most = out[row + t], self.limits.most(int(self.length[i]))
                if here.get(i, most + 1) > 0:
                    edits = self.distance(found, t, i, int(s))
                    if edits <= min(most, here.get(i, most)):
                        here[i] = edits
        return out


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """``docs`` with item_ids (sorted, empty if clean) and item_edits (edits of each); such columns are replaced."""
    kept = [c for c in docs.columns if c.lower() not in FOUND]
    small_batches(docs)
    empty = F.array().cast("array<long>")
    out = docs.select(*kept, empty.alias("item_ids"), empty.alias("item_edits"))
    blocks = max(1, ceil(items.count() / ITEM_BLOCK))
    numbered = items.select(F.col(item_id).cast("long"), F.col(item_text)).filter(F.col(item_text).isNotNull())
    for block in range(blocks):
        part = numbered.filter(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == block)
        rows = sorted((r[0], r[1]) for r in part.collect() if r[0] is not None)
        held = docs.sparkSession.sparkContext.broadcast(Items(rows, limits))
        out = out.mapInArrow(_adder(held, kept.index(text), len(kept)), out.schema)
    return out


def _adder(held, text_at: int, columns: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            ids, edits = [], []
            before = zip(batch.column(columns).to_pylist(), batch.column(columns + 1).to_pylist())
            for (old, old_edits), new in zip(before, items.matches(batch.column(text_at))):
                every = sorted([*zip(old, old_edits), *((int(items.ids[i]), e) for i, e in new.items())])
                ids.append([i for i, _ in every])
                edits.append([e for _, e in every])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], pa.array(ids, pa.list_(pa.int64())), pa.array(edits, pa.list_(pa.int64()))],
                names=batch.schema.names)
    return add


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text", **more) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    own, back = aside(docs, FOUND)
    found = find_items(own, items, text, **more)
    return found.filter(F.size("item_ids") == 0).select(*own.columns).withColumnsRenamed(back)
