"""Quality rules: text statistics, and perplexity bands of a modified Kneser-Ney model per language.

The model is over bytes (white space of any kind is a blank). Spark counts the n-grams of the
highest order over every text, by language; lower orders follow from how many different n-grams continue
them. Each n-gram's hash, its interpolated probability and, for contexts, the weight left for shorter
ones, are stored in arrays sorted by hash with a directory of their leading bits. No n-gram is left out: a model of
more than ``SHARD_NGRAMS`` is cut into shards by language and by the two bytes before the last, which an n-gram of
three or more bytes, its context and its suffixes down to three bytes share, so each shard has all that their
probabilities need. Shorter ones are in every shard of their language. A task has one shard in memory at a time.

A document's log-perplexity is the mean negative log-probability of its bytes. Each language gets a band from
all its documents that pass the statistics: quartiles, from a histogram in steps of a thousandth, widened by
``spread`` times their distance. Documents outside are rejected. The mean over a short text varies more, so the
band of a text under ``full_chars`` word characters is wider by the root of what is missing. A language with fewer than
``least_docs`` such documents has no band; a document shorter than the order has no perplexity and passes.

Definitions: a null text has no words and fails the word minimum; a null language is one more language;
repeated rows count and are judged each by itself; columns of the same names as new ones are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import shared_folder, stage
from .text import aside, small_batches
from .words import IS_SPACE, U, Words, mixed, text_slices, windows, words_of

ORDER = 5
SHARD_NGRAMS = 4_000_000
HELD_BYTES = 16 << 20
FLUSH = 500_000
BIN = 1000
JUDGED = ("log_perplexity", "base_failed", "kept", "band_lang", "q1", "q3", "wide")
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
BLANKED = np.arange(256, dtype=np.uint64)
BLANKED[IS_SPACE] = 32


# --- statistics of a text -----------------------------------------------------------------------
def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(flags)]
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the (owner, hash) pairs, and for each place in it whether it equals the one before."""
    key = mixed(hashes + mixed(owner.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    return order, np.r_[False, key[order][1:] == key[order][:-1]] if len(key) else np.zeros(0, bool)


def statistics(words: Words) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    texts = len(words)
    n_words = words.counts()
    space = IS_SPACE[words.data]
    line_end = np.flatnonzero(words.data == 10)
    # lines: between text borders and line feeds
    start = np.sort(np.r_[words.offsets[:-1], line_end + 1])
    end = np.sort(np.r_[line_end, words.offsets[1:]])
    text = np.repeat(np.arange(texts), _per_text(words.data == 10, words.offsets) + 1)
    with_word = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end, text = start[with_word], end[with_word], text[with_word]
    order, again = _repeated(words.span_hash(start, end), text)
    dup_lines = np.bincount(text[order][again], minlength=texts)
    grams = windows(words.hash, 3)
    owner = np.repeat(np.arange(texts), n_words)
    inside = owner[2:] == owner[:-2] if len(owner) > 2 else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    order, again = _repeated(grams[at], owner[at])
    twice = again | np.r_[again[1:], False] if len(again) else again
    hit = at[order][twice]
    covered = np.zeros(len(owner), bool)
    for i in range(3):
        covered[hit + i] = True
    return {
        "n_words": n_words, "word_chars": _per_text(STARTS_CHAR[words.data] & ~space, words.offsets),
        "n_symbols": _per_text(IS_SYMBOL[words.data], words.offsets), "n_dup_lines": dup_lines,
        "n_repeat_words": np.bincount(owner[covered], minlength=texts),
    }


# --- the model ----------------------------------------------------------------------------------
def packed(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on in one number."""
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, U)
    values = BLANKED[data]
    out = values[:size].copy()
    for i in range(1, n):
        out = (out << U(8)) | values[i:i + size]
    return out


def _inside(words: Words, n: int) -> np.ndarray:
    """Places where n bytes from there on are of one text."""
    owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(words.offsets))
    return owner[n - 1:] == owner[:len(owner) - n + 1] if len(owner) >= n else np.zeros(0, bool)


def count_ngrams(docs: DataFrame, text: str, lang: str, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) of all texts, summed first within slices and tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def merge(parts):
            gram = np.concatenate([p[0] for p in parts])
            gram, back = np.unique(gram, return_inverse=True)
            return gram, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def rows(name, gram, n):
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            names = batch.column(1)
            for name in names.unique().to_pylist():
                mine = pc.is_null(names) if name is None else pc.fill_null(pc.equal(names, name), False)
                for _, part in text_slices(batch.column(0).filter(mine)):
                    words = words_of(part)
                    gram, n = np.unique(packed(words.data, order)[_inside(words, order)], return_counts=True)
                    parts = held.setdefault(name, [])
                    parts.append((gram, n))
                    if sum(len(p[0]) for p in parts) > 2 * FLUSH:
                        held[name] = [merge(parts)]
                        if len(held[name][0][0]) > FLUSH:
                            yield rows(name, *held.pop(name)[0])
        for name, parts in held.items():
            yield rows(name, *merge(parts))

    small_batches(docs)
    counts = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(count, "lang string, gram long, n long")
    return counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class HashArray:
    """Values by 64-bit hash: sorted hashes, and where each leading-bits group starts."""

    key: np.ndarray
    value: np.ndarray

    def __post_init__(self):
        order = np.argsort(self.key, kind="stable")
        self.key, self.value = self.key[order], self.value[order]
        self.shift = U(64 - max(1, len(self.key).bit_length()))
        tops = np.arange((1 << int(U(64) - self.shift)) + 1, dtype=np.float64) * 2.0 ** float(self.shift)
        self.begin = np.searchsorted(self.key, np.minimum(tops, 1.8446744073709550e19).astype(U)).astype(np.int32)
        self.key = np.r_[self.key, U(0xFFFFFFFFFFFFFFFF)]
        self.value = np.r_[self.value, self.value[:1] if len(self.value) else np.zeros(1)]

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key; the value is meaningless where it is not found."""
        at = self.begin[(key >> self.shift).astype(np.int64)]
        todo = np.flatnonzero(self.key[at] < key)
        while len(todo):
            at[todo] += 1
            todo = todo[self.key[at[todo]] < key[todo]]
        return self.key[at] == key, self.value[at]


def ngram_hash(gram: np.ndarray, n: int, lang: int) -> np.ndarray:
    return mixed(gram + mixed(np.full(1, lang * 16 + n, U)))


def _discounts(counts: np.ndarray) -> np.ndarray:
    """D for counts 1, 2 and 3 or more, from how many n-grams occur once to four times."""
    return _discounts_of(np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(float))


def _discounts_of(n: np.ndarray) -> np.ndarray:
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3)]
    return np.array([0.0, *(min(max(x, 0.05), k * 0.95) for k, x in zip((1, 2, 3), d))])


@dataclass
class Corpus:
    """What a shard must know of all n-grams: ids of the languages, discounts by language and length, and by
    language the two-byte n-grams with their counts."""

    langs: dict[str | None, int]
    discounts: dict[tuple[str | None, int], np.ndarray]
    pairs: dict[str | None, tuple[np.ndarray, np.ndarray]]


class KneserNey:
    """Interpolated modified Kneser-Ney probabilities of byte n-grams for several languages.

    Without ``corpus`` the counts are all there are; with it, those of one shard.
    """

    def __init__(self, counts: dict[str | None, tuple[np.ndarray, np.ndarray]], order: int = ORDER, corpus: Corpus | None = None):
        self.order = order
        self.langs = corpus.langs if corpus else {name: i for i, name in enumerate(sorted(counts, key=str))}
        grams: list[list] = [[] for _ in range(order + 1)]
        probs: list[list] = [[] for _ in range(order + 1)]
        contexts: list[list] = [[] for _ in range(order + 1)]
        weights: list[list] = [[] for _ in range(order + 1)]
        for name, (gram, n) in counts.items():
            lang = self.langs[name]
            levels = {order: (gram, n)}
            for k in range(order - 1, 0, -1):
                levels[k] = corpus.pairs[name] if corpus and k == 2 else np.unique(
                    levels[k + 1][0] & U((1 << 8 * k) - 1), return_counts=True)
            below, below_p = None, None
            for k in range(1, order + 1):
                gram, n = levels[k]
                d = corpus.discounts[name, k] if corpus and k > 2 else _discounts(n)
                context, back = np.unique(gram >> U(8), return_inverse=True)
                total = np.bincount(back, n)
                cut = d[np.minimum(n, 3)]
                left = np.bincount(back, cut) / total
                if k == 1:
                    lower = 1.0 / 257
                else:
                    at = np.searchsorted(below, gram & U((1 << 8 * (k - 1)) - 1))
                    lower = below_p[at]
                p = (n - cut) / total[back] + left[back] * lower
                grams[k].append(ngram_hash(gram, k, lang))
                probs[k].append(np.log(p))
                contexts[k].append(ngram_hash(context, k + 8, lang))
                weights[k].append(np.log(left))
                below, below_p = gram, p
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
        self.gram = [None, *(HashArray(join(grams[k]).astype(U), join(probs[k]).astype(np.float32)) for k in range(1, order + 1))]
        self.context = [None, *(HashArray(join(contexts[k]).astype(U), join(weights[k]).astype(np.float32)) for k in range(1, order + 1))]

    def log_probability(self, gram: np.ndarray, lang: int) -> np.ndarray:
        """Of the last byte of each packed n-gram after the others; for an unknown byte a uniform share of what is left."""
        out = np.zeros(len(gram))
        todo = np.arange(len(gram))
        for k in range(self.order, 0, -1):
            if not len(todo):
                return out
            g = gram[todo] & U((1 << 8 * k) - 1) if k < 8 else gram[todo]
            found, value = self.gram[k].find(ngram_hash(g, k, lang))
            out[todo[found]] += value[found]
            todo, g = todo[~found], g[~found]
            known, weight = self.context[k].find(ngram_hash(g >> U(8), k + 8, lang))
            out[todo[known]] += weight[known]
        out[todo] += np.log(1.0 / 257)
        return out


@dataclass
class Shards:
    """A model as broadcast ``KneserNey`` parts; ``first`` is the least key (language, two bytes) of each."""

    langs: dict[str | None, int]
    order: int
    first: np.ndarray
    parts: list

    @staticmethod
    def of(spark, model: "KneserNey | Shards") -> "Shards":
        if isinstance(model, Shards):
            return model
        return Shards(model.langs, model.order, np.zeros(1, np.int64), [spark.sparkContext.broadcast(model)])

    @property
    def held_bytes(self) -> int:
        """Bytes of text worth holding for one walk over the parts."""
        return HELD_BYTES if len(self.parts) > 1 else 0

    def look_up(self, grams: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """Log-probabilities of packed n-grams by language; each part is loaded once and let go."""
        out = {lang: np.zeros(len(g)) for lang, g in grams.items()}
        to = {lang: np.searchsorted(self.first, (lang << 16) + (g >> U(8) & U(0xFFFF)).astype(np.int64), "right") - 1
              for lang, g in grams.items()}
        for i, held in enumerate(self.parts):
            mine = {lang: at for lang in grams if len(at := np.flatnonzero(to[lang] == i))}
            if not mine:
                continue
            part = held.value
            if len(self.parts) > 1 and held._path:  # else it stays loaded beside the next one
                vars(held).pop("_value", None)
            for lang, at in mine.items():
                out[lang][at] = part.log_probability(grams[lang][at], lang)
            del part
        return out

    def log_probability(self, gram: np.ndarray, lang: int) -> np.ndarray:
        return self.look_up({lang: gram})[lang]


def mean_negative_log(texts: Iterator[tuple[int, Words]], model: Shards) -> list[np.ndarray]:
    """Log-perplexity of each text of each (language, words), NaN for those shorter than the order."""
    slices = []
    for lang, words in texts:
        inside = _inside(words, model.order)
        at = np.flatnonzero(inside)
        unique, back = np.unique(packed(words.data, model.order)[at], return_inverse=True)
        flags = np.zeros(len(words.data), bool)
        flags[at] = True
        slices.append((lang, unique, back.astype(np.int32), _per_text(flags, words.offsets)))
    grams = {}
    for lang in {x[0] for x in slices}:
        mine = [x[1] for x in slices if x[0] == lang]
        grams[lang] = np.unique(np.concatenate(mine)) if len(mine) > 1 else mine[0]
    found, out = model.look_up(grams), []
    for lang, unique, back, n in slices:
        values = found[lang][np.searchsorted(grams[lang], unique)][back]
        sums = np.r_[0, np.cumsum(values)][np.r_[0, np.cumsum(n)]]
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append(-np.diff(sums) / n)
    return out


def _by_language(table: pa.Table) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """(gram, n) of each language in order of gram."""
    found = {}
    for name in table.column("lang").unique().to_pylist():
        mine = table.filter(pc.is_null(table["lang"]) if name is None else pc.fill_null(pc.equal(table["lang"], name), False))
        gram = mine.column("gram").to_numpy().view(U)
        by = np.argsort(gram)
        found[name] = gram[by], mine.column("n").to_numpy()[by]
    return found


def survey(counts: DataFrame, order: int) -> Corpus:
    """Discounts and two-byte n-grams from all counts, by grouping them in Spark."""
    level, discounts = counts, {}
    for k in range(order, 2, -1):
        seen = level.groupBy("lang").agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in range(1, 5)])
        for row in seen.collect():
            discounts[row["lang"], k] = _discounts_of(np.array(row[1:], float))
        level = stage(level.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)).alias("gram")).agg(
            F.count(F.lit(1)).alias("n")), f"ngrams-{k - 1}")
    pairs = _by_language(level.toArrow())
    return Corpus({name: i for i, name in enumerate(sorted(pairs, key=str))}, discounts, pairs)


def _sharded(counts: DataFrame, order: int) -> Shards:
    spark = counts.sparkSession
    corpus = survey(counts, order)
    counts = counts.withColumn("pair", F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF)))
    groups = sorted((corpus.langs[r["lang"]], r["pair"], r["count"], r["lang"]) for r in counts.groupBy("lang", "pair").count().collect())
    first, placed, size, last = [], [], SHARD_NGRAMS, None
    for lang, pair, n, name in groups:
        if size + n > SHARD_NGRAMS and size:
            first.append((lang << 16) + (pair if lang == last else 0))
            size = 0
        placed.append((name, pair, len(first) - 1))
        size, last = size + n, lang
    places = spark.createDataFrame(placed, "name string, at long, shard int")
    path = f"{shared_folder(spark)}/fieldloom/ngram-shards-{uuid.uuid4().hex}"
    counts.join(F.broadcast(places), F.col("lang").eqNullSafe(F.col("name")) & (F.col("pair") == F.col("at"))).select(
        "lang", "gram", "n", "shard").write.partitionBy("shard").parquet(path)
    stored = spark.read.schema("lang string, gram long, n long, shard int").parquet(path)
    parts = []
    for i in range(len(first)):
        part = _by_language(stored.filter(F.col("shard") == i).select("lang", "gram", "n").toArrow())
        parts.append(spark.sparkContext.broadcast(KneserNey(part, order, corpus)))
    return Shards(corpus.langs, order, np.array(first, np.int64), parts)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> KneserNey | Shards:
    """Count in Spark, store, and build the arrays, one shard after another."""
    counts = stage(count_ngrams(docs, text, lang, order), "ngrams")
    if order > 2 and counts.count() > SHARD_NGRAMS:
        return _sharded(counts, order)
    return KneserNey(_by_language(counts.toArrow()), order)


# --- the rules ----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Rules:
    least_words: int = 50
    most_repeat: int = 50  # per cent of the words
    spread: float = 2.5
    full_chars: int = 1500
    least_docs: int = 100


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together while they have fewer than ``most`` bytes."""
    pending: list[pa.RecordBatch] = []
    for batch in batches:
        pending.append(batch)
        if sum(b.nbytes for b in pending) >= most:
            yield pending[0] if len(pending) == 1 else pa.concat_batches(pending)
            pending = []
    if pending:
        yield pa.concat_batches(pending)


def measure(docs: DataFrame, model: KneserNey | Shards, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with the five statistics and log_perplexity."""
    kept = [c for c in docs.columns if c.lower() not in (*STATISTICS, "log_perplexity")]
    small_batches(docs)
    zero = [F.lit(0).cast("long").alias(c) for c in STATISTICS]
    wide = docs.select(*kept, *zero, F.lit(None).cast("double").alias("log_perplexity"))
    model = Shards.of(docs.sparkSession, model)
    text_at, lang_at, columns = kept.index(text), kept.index(lang), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _held(batches, model.held_bytes):
            found = {c: np.zeros(len(batch), np.int64) for c in STATISTICS}
            score = np.full(len(batch), np.nan)
            names = batch.column(lang_at)
            scored = []

            def known() -> Iterator[tuple[int, Words]]:
                for name in names.unique().to_pylist():
                    mine = pc.is_null(names) if name is None else pc.fill_null(pc.equal(names, name), False)
                    rows = np.flatnonzero(mine.to_numpy(zero_copy_only=False))
                    for at, part in text_slices(batch.column(text_at).filter(mine)):
                        words = words_of(part)
                        here = rows[at:at + len(part)]
                        for c, values in statistics(words).items():
                            found[c][here] = values
                        if name in model.langs:
                            scored.append(here)
                            yield model.langs[name], words

            for here, values in zip(scored, mean_negative_log(known(), model)):
                score[here] = values
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], *(pa.array(found[c]) for c in STATISTICS),
                 pa.array(score, pa.float64(), from_pandas=True)], names=batch.schema.names)

    return wide.mapInArrow(run, wide.schema)


def failed(rules: Rules):
    return (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeat * F.col("n_words"))


def bands(measured: DataFrame, rules: Rules, lang: str = "lang") -> DataFrame:
    """(band_lang, q1, q3, wide) by language, from the quartiles of documents that pass the statistics."""
    bins = measured.filter(~failed(rules) & F.col("log_perplexity").isNotNull()).groupBy(
        F.col(lang).alias("band_lang"), F.round(F.col("log_perplexity") * BIN).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("band_lang").orderBy("bin")
    placed = bins.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("band_lang")))
    at = lambda q: F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / BIN
    quartiles = placed.filter(F.col("all") >= rules.least_docs).groupBy("band_lang").agg(at(0.25).alias("q1"), at(0.75).alias("q3"))
    wide = F.lit(rules.spread) * F.greatest(F.col("q3") - F.col("q1"), F.lit(1.0 / BIN))
    return quartiles.select("band_lang", "q1", "q3", wide.alias("wide"))


def accepted(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    own, back = aside(docs, (*STATISTICS, *JUDGED))
    return judge(own, text, lang, rules).filter("kept").select(*own.columns).withColumnsRenamed(back)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the statistics, log_perplexity, base_failed and kept."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in JUDGED])
    measured = measure(docs, fit(docs, text, lang), text, lang)
    slim = stage(measured.select(F.col(lang).alias("lang"), *STATISTICS, "log_perplexity"), "measured-bands")
    limits = stage(bands(slim, rules), "bands")
    joined = measured.join(F.broadcast(limits) if limits.count() <= 10_000 else limits,
                           F.col(lang).eqNullSafe(F.col("band_lang")), "left")
    wide = F.col("wide") * F.sqrt(F.greatest(F.lit(1.0), F.lit(float(rules.full_chars)) / F.greatest("word_chars", F.lit(1))))
    low, high = F.col("q1") - wide, F.col("q3") + wide
    outside = F.coalesce((F.col("log_perplexity") < low) | (F.col("log_perplexity") > high), F.lit(False))
    return joined.withColumn("base_failed", failed(rules)).withColumn(
        "kept", ~F.col("base_failed") & ~outside).drop("band_lang", "q1", "q3", "wide")
