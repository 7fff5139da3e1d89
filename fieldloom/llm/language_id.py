"""Language identification, words first, backing off to shorter character n-grams.

A word known to the model gives each language the log of its relative frequency there. For an unknown word
the longest character n-grams are tried, then shorter ones: the first length at which the model knows any of
its n-grams gives their mean log frequencies. A document's score per language is the mean over its
words; the answer is the best, its score the posterior if each of at most ``SURE_WORDS`` words counted.

Words are runs of letters of the lower-cased text; n-grams include the blanks around a word. The tables hold
hashes and are made from a sample of at most about ``sample_docs`` labelled documents; words and n-grams
rarer than the least count that leaves ``most_entries`` of a kind are left out.

Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was labelled.
Among equal languages the first in alphabetical order wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .perplexity import HashArray
from .text import small_batches
from .words import LENGTH_TAG, PLACE, SLICE_BYTES, U, BASE, BASE_INVERSE, mixed, powers, text_slices

GRAM = 4
SURE_WORDS = 30
_LETTERS: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For every code point whether it is a letter; made once per process."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


@dataclass
class Letters:
    """Lower-cased code points of some texts, other characters as blanks, and their words."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # range of words of each text

    def word_hash(self) -> np.ndarray:
        sums = np.zeros(len(self.points) + 1, U)
        np.cumsum(mixed(self.points + U(1)) * powers(BASE, len(self.points)), out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * powers(BASE_INVERSE, len(sums))[self.start])

    def gram_hash(self, n: int) -> np.ndarray:
        """Hash of the n code points from each place on."""
        size = len(self.points) - n + 1
        if size <= 0:
            return np.zeros(0, U)
        total = np.full(size, LENGTH_TAG[n], U)
        for i in range(n):
            total += self.points[i:i + size] * PLACE[i]
        return mixed(total)


def letters_of(texts: list[str | None]) -> Letters:
    low = [" " + t.lower() + " " if t else "  " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[points]
    points = np.where(letter, points, 32).astype(U)
    edge = np.diff(np.r_[False, letter, False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.r_[0, np.cumsum([len(t) for t in low])]
    return Letters(points, start, end, np.searchsorted(start, offsets))


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[i], lo[i]+1, ... n[i] numbers for each i."""
    return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def count_features(train: DataFrame, text: str, lang: str) -> DataFrame:
    """(kind, hash, lang, n): kind 0 are words, others n-grams of that length."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for name in sorted(set(langs)):
                mine = batch.column(0).filter(pa.array(langs == name))
                for _, part in text_slices(mine):
                    found = letters_of(part.to_pylist())
                    for kind in range(GRAM + 1):
                        if kind == 0:
                            keys = found.word_hash()
                        else:
                            room = np.maximum(0, found.end - found.start + 3 - kind)
                            keys = found.gram_hash(kind)[_spread(found.start - 1, room)]
                        key, n = np.unique(keys, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)),
                             pa.array([name] * len(key), pa.string()), pa.array(n)], ["kind", "hash", "lang", "n"])

    small_batches(train)
    rows = train.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(count, "kind int, hash long, lang string, n long").groupBy("kind", "hash", "lang").agg(F.sum("n").alias("n"))


class LanguageModel:
    def __init__(self, table: pa.Table, totals: dict[tuple[int, str], int]):
        self.langs = sorted({lang for _, lang in totals})
        at = {lang: i for i, lang in enumerate(self.langs)}
        kinds = table.column("kind").to_numpy()
        self.index, self.logs = [], []
        for kind in range(GRAM + 1):
            mine = np.flatnonzero(kinds == kind)
            key, back = np.unique(table.column("hash").to_numpy().view(U)[mine], return_inverse=True)
            counts = np.zeros((len(key) + 1, len(self.langs)))
            codes = np.array([at[x] for x in table.column("lang").take(mine).to_pylist()], int)
            np.add.at(counts, (back, codes), table.column("n").to_numpy()[mine])
            all_of = np.array([totals.get((kind, lang), 0) for lang in self.langs], float)
            self.index.append(HashArray(key, np.arange(len(key), dtype=np.float64)))
            self.logs.append(np.log((counts + 0.5) / (all_of + 0.5 * (len(key) + 1))).astype(np.float32))

    def word_scores(self, found: Letters) -> np.ndarray:
        """Log frequencies of each word, words x languages; zero for a word of which nothing is known."""
        out = np.zeros((len(found.start), len(self.langs)), np.float32)
        known, at = self.index[0].find(found.word_hash())
        out[known] = self.logs[0][at[known].astype(np.int64)]
        todo = np.flatnonzero(~known)
        for kind in range(GRAM, 0, -1):
            room = np.maximum(0, found.end[todo] - found.start[todo] + 3 - kind)
            word = np.repeat(np.arange(len(todo)), room)
            hit, at = self.index[kind].find(found.gram_hash(kind)[_spread(found.start[todo] - 1, room)])
            word, at = word[hit], at[hit].astype(np.int64)
            n = np.bincount(word, minlength=len(todo))
            good = n > 0
            for i in range(len(self.langs)):
                sums = np.bincount(word, self.logs[kind][at, i], len(todo))
                out[todo[good], i] = sums[good] / n[good]
            todo = todo[~good]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = letters_of(texts)
        n = np.diff(found.first)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        sums = np.r_[np.zeros((1, len(self.langs))), np.cumsum(self.word_scores(found).astype(np.float64), 0)]
        mean = (sums[found.first[1:]] - sums[found.first[:-1]]) / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        odds = np.exp((mean - mean.max(1, keepdims=True)) * np.minimum(n, SURE_WORDS)[:, None])
        score = np.where(n > 0, 1 / odds.sum(1), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best, n)], score


def fit(train: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = 20_000,
        most_entries: int = 200_000) -> LanguageModel:
    """Learn from documents with text and language; a hash of the text draws the sample."""
    labelled = train.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    share = min(1.0, sample_docs / max(1, labelled.count()))
    drawn = labelled.filter(F.pmod(F.xxhash64(text), F.lit(1_000_003)) < int(share * 1_000_003) + 1)
    counts = stage(count_features(drawn, text, lang), "language-counts")
    totals = {(r["kind"], r["lang"]): r["n"] for r in counts.groupBy("kind", "lang").agg(F.sum("n").alias("n")).collect()}
    whole = counts.groupBy("kind", "hash").agg(F.sum("n").alias("all"))
    kept = stage(counts.join(whole, ["kind", "hash"]), "language-entries")
    parts = []
    for kind in range(GRAM + 1):
        mine, least = kept.filter(F.col("kind") == kind), 2
        while mine.filter(F.col("all") >= least).count() > most_entries:
            least *= 2
        parts.append(mine.filter(F.col("all") >= least).select("kind", "hash", "lang", "n").toArrow())
    return LanguageModel(pa.concat_tables(parts).combine_chunks(), totals)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; columns of those names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    small_batches(docs)
    wide = docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    at, columns = kept.index(text), len(kept)
    most = max(1 << 16, SLICE_BYTES * 8 // max(8, len(model.langs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            langs, scores = [], []
            for _, part in text_slices(batch.column(at), most):
                found, score = model.predict(part.to_pylist())
                langs += found
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], pa.array(langs, pa.string()),
                 pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=batch.schema.names)

    return wide.mapInArrow(run, wide.schema)
