"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns words into symbols: insults and threats with weights, targets (you, they ...),
negations, reporting verbs and quotation marks. Small automata for insult, threat, target, negation and reported
speech read the symbols of a clause in step; their product is a table built once. What it accepts are matched
clauses: an insult or a threat together with whether it is aimed, negated or reported, which scales its
weight. Words outside such clauses count for nothing.

Insult entries are a fixed list and what labelled documents teach: words and stems (leading letters) that
toxic documents hold far more often, by log-likelihood ratio, weighted by their log-odds. A logistic
curve over the clause weights of the same documents turns the sum into a score.

At most about ``LABELLED`` documents of each label are learnt from, drawn by a hash of their id and weighted up
again. Null and empty texts have no clause and get the lowest score; documents without label teach
nothing; if there are no labels only the fixed list is used, with default weights.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .text import small_batches

LABELLED = 3000
FLUSH = 200_000
STEMS = (4, 5, 6)
MOST_ENTRIES = 5000
LEAST_DOCS = 5
LEAST_RATIO = 25.0
#: Fixed word lists, lower case.
INSULTS = ("idiot", "idiots", "scum", "stupid", "loser", "losers", "moron", "morons", "trash", "pathetic", "worthless",
           "disgusting", "clown", "imbecile", "dumb", "idiota", "imbécil", "estúpido", "idiote", "stupide", "dumm", "dummkopf")
THREATS = ("kill", "hurt", "destroy", "stab", "shoot", "burn", "beat", "punch", "matar", "tuer", "töten")
TARGETS = ("you", "your", "you're", "he", "she", "they", "them", "him", "her", "tu", "vous", "du", "ihr", "tú", "usted")
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "don't", "won't", "nicht", "kein", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "called", "calls", "wrote", "reported", "claimed", "quoted", "sagte", "dit", "dijo")
#: Fixed weights of a matched clause by its context.
CONTEXT = {"plain": 1.0, "aimed": 1.25, "negated": 0.25, "reported": 0.4}
DEFAULT_WEIGHT = 3.0
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;\n\"“”«»]")
CLAUSE_END = set(".!?;\n")
QUOTES = set("\"“”«»")


# --- automata -----------------------------------------------------------------------------------
@dataclass
class Machine:
    """A deterministic automaton over symbols: start state, and moves where the state changes."""

    start: int
    moves: dict[tuple[int, str], int]

    def step(self, state: int, symbol: str) -> int:
        return self.moves.get((state, symbol), state)


SYMBOLS = ("insult", "threat", "target", "negation", "report", "quote", "word")
INSULT = Machine(0, {(0, "insult"): 1, **{(1, s): 0 for s in SYMBOLS if s != "insult"}})
THREAT = Machine(0, {(0, "threat"): 1, **{(1, s): 0 for s in SYMBOLS if s != "threat"}})
TARGET = Machine(0, {(0, "target"): 1})
#: A negation reaches three words on.
NEGATION = Machine(0, {**{(k, "negation"): 3 for k in range(4)},
                       **{(k, s): k - 1 for k in (1, 2, 3) for s in SYMBOLS if s not in ("negation", "quote")}})
#: 1 after a reporting verb, 2 within quotation marks.
REPORTED = Machine(0, {(0, "report"): 1, (0, "quote"): 2, (1, "quote"): 2, (2, "quote"): 1})


def compose(*machines: Machine) -> tuple[tuple[int, ...], dict]:
    """The product automaton: start state, and (state, symbol) -> state for all reachable states."""
    start = tuple(m.start for m in machines)
    table, todo = {}, [start]
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            new = tuple(m.step(s, symbol) for m, s in zip(machines, state))
            if (state, symbol) not in table:
                table[state, symbol] = new
                if (new, SYMBOLS[0]) not in table:
                    todo.append(new)
    return start, table


GRAMMAR = compose(INSULT, THREAT, TARGET, NEGATION, REPORTED)


def clause_matches(symbols: list[tuple[str, float]]) -> list[tuple[str, str, float]]:
    """(kind, context, weight) of each match in the symbols of one clause."""
    state, table = GRAMMAR
    aimed = any(s == "target" for s, _ in symbols)
    out = []
    for symbol, weight in symbols:
        negated = state[3] > 0
        state = table[state, symbol]
        if symbol in ("insult", "threat"):
            if symbol == "threat" and not aimed:
                continue  # a threat needs somebody
            context = "reported" if state[4] else "negated" if negated else "aimed" if aimed else "plain"
            out.append((symbol, context, weight * CONTEXT[context]))
    return out


# --- lexicon ------------------------------------------------------------------------------------
@dataclass
class Grammar:
    """Lexical transducer and the curve from clause weights to a score."""

    words: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-4.0, 3.0, 1.0)

    def finder(self):
        found = ahocorasick.Automaton()
        for entry in {*self.words, *self.stems, *THREATS}:
            found.add_word(entry, len(entry))
        found.make_automaton()
        return found

    def symbol(self, word: str) -> tuple[str, float]:
        weight = self.words.get(word)
        if weight is None:
            weight = max((self.stems[word[:k]] for k in STEMS if word[:k] in self.stems), default=None)
        if weight is not None:
            return "insult", weight
        for name, words in _CLASSES:
            if word in words:
                return name, DEFAULT_WEIGHT
        return ("quote" if word in QUOTES else "word"), 0.0

    def features(self, text: str | None, finder) -> tuple[float, int]:
        """(sum of the weights, number) of the matched clauses of a text."""
        low = (text or "").lower()
        if not low or not any(end - size < 0 or not low[end - size].isalnum() for end, size in finder.iter(low)):
            return 0.0, 0
        total, clauses, clause = 0.0, 0, []
        for token in [*TOKEN.findall(low), "."]:
            if token in CLAUSE_END:
                found = clause_matches(clause) if any(s in ("insult", "threat") for s, _ in clause) else []
                total += sum(w for _, _, w in found)
                clauses += bool(found)
                clause = []
            else:
                clause.append(self.symbol(token))
        return total, clauses

    def score(self, total, clauses):
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * np.log1p(total) + c * np.log1p(clauses))))


_CLASSES = [("threat", frozenset(THREATS)), ("target", frozenset(TARGETS)), ("negation", frozenset(NEGATIONS)),
            ("report", frozenset(REPORTS))]


def entries_of(text: str) -> set[str]:
    """The words of a text, and their stems marked with a star."""
    words = set(re.findall(r"[^\W\d_]+", text.lower()))
    return {w for w in words if 2 < len(w) <= 24} | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def count_entries(rows: DataFrame, only: frozenset[str] | None = None) -> DataFrame:
    """(entry, docs): how many texts hold each entry (of ``only``); ``rows`` has text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = entries_of(text or "")
                held.update(found if only is None else found & only)
            if len(held) > FLUSH:
                yield table(held)
                held = Counter()
        yield table(held)

    def table(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["entry", "docs"])

    small_batches(rows)
    return rows.select("text").mapInArrow(count, "entry string, docs long").groupBy("entry").agg(F.sum("docs").alias("docs"))


def _ratio(a, b, toxic: int, clean: int) -> Column:
    """Log-likelihood ratio of the shares a / toxic and b / clean against their common share."""
    part = lambda k, n, p: k * F.log(p) + (n - k) * F.log(1 - p)
    tiny = lambda k, n: F.least(F.greatest(k / n, F.lit(1e-9)), F.lit(1 - 1e-9))
    pooled = tiny(a + b, F.lit(float(toxic + clean)))
    t, c = F.lit(float(toxic)), F.lit(float(clean))
    return 2 * (part(a, t, tiny(a, t)) + part(b, c, tiny(b, c)) - part(a, t, pooled) - part(b, c, pooled))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge * beta
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curvature, gradient)
        beta += step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        labelled: int = LABELLED) -> Grammar:
    """Learn entries and the curve from the ``labels`` (doc_id, label 0 or 1, others are left out) of ``docs``.

    The sample is drawn from the labels alone, so that only its few rows meet the texts.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("i"), F.col(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    base = {w: DEFAULT_WEIGHT for w in INSULTS}
    if not sizes.get(0) or not sizes.get(1):
        return Grammar(base)
    share = {k: min(1.0, labelled / n) for k, n in sizes.items()}
    limit = F.when(F.col("label") == 1, int(share[1] * 1_000_003) + 1).otherwise(int(share[0] * 1_000_003) + 1)
    few = rows.filter(F.pmod(F.xxhash64("i"), F.lit(1_000_003)) < limit)
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("d"), F.col(text).alias("text"))
    # At most about twice ``labelled`` rows.
    drawn = stage(texts.join(F.broadcast(few), F.col("d") == F.col("i")).select("text", "label"), "toxic-sample")
    got = {r["label"]: r["count"] for r in drawn.groupBy("label").count().collect()}
    if not got.get(0) or not got.get(1):
        return Grammar(base)
    toxic, clean = got.get(1, 0), got.get(0, 0)
    # Entries of the toxic sample first; in the clean one only those are counted.
    often = stage(count_entries(drawn.filter("label = 1")).filter(F.col("docs") >= LEAST_DOCS), "toxic-entries")
    known = frozenset(r["entry"] for r in often.select("entry").collect())
    rare = count_entries(drawn.filter("label = 0"), known).withColumnsRenamed({"entry": "e", "docs": "clean"})
    both = often.join(rare, F.col("entry") == F.col("e"), "left")
    a, b = F.col("docs").cast("double"), F.coalesce("clean", F.lit(0)).cast("double")
    odds = F.log((a + 0.5) / (toxic + 1.0)) - F.log((b + 0.5) / (clean + 1.0))
    chosen = both.select("entry", odds.alias("odds"), _ratio(a, b, toxic, clean).alias("ratio"))
    chosen = chosen.filter((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") >= 2.0))
    learnt = {r["entry"]: r["odds"] for r in chosen.orderBy(F.desc("ratio"), "entry").limit(MOST_ENTRIES).collect()}
    words = base | {e: w for e, w in learnt.items() if not e.endswith("*")}
    grammar = Grammar(words, {e[:-1]: w for e, w in learnt.items() if e.endswith("*")})
    seen = measure(drawn, grammar).select("label", "clause_weight", "clauses").toPandas()
    x = np.stack([np.ones(len(seen)), np.log1p(seen["clause_weight"]), np.log1p(seen["clauses"])], 1)
    y = seen["label"].to_numpy()
    weight = np.where(y == 1, 1 / share[1], 1 / share[0])
    weight = weight / weight.mean()
    grammar.curve = tuple(float(v) for v in logistic(x, y, weight))
    return grammar


def measure(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """``docs`` with clause_weight and clauses; columns of those names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("clause_weight", "clauses")]
    small_batches(docs)
    wide = docs.select(*kept, F.lit(0.0).alias("clause_weight"), F.lit(0).cast("long").alias("clauses"))
    held, at, columns = docs.sparkSession.sparkContext.broadcast(grammar), kept.index(text), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = held.value
        finder = grammar.finder()
        for batch in batches:
            found = [grammar.features(t.as_py(), finder) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:columns], pa.array([f[0] for f in found], pa.float64()),
                 pa.array([f[1] for f in found], pa.int64())], names=batch.schema.names)

    return wide.mapInArrow(run, wide.schema)


def score(docs: DataFrame, grammar: Grammar, text: str = "text") -> DataFrame:
    """``docs`` with clause_weight, clauses and score (0 to 1)."""
    a, b, c = grammar.curve
    line = F.lit(a) + F.lit(b) * F.log1p("clause_weight") + F.lit(c) * F.log1p("clauses")
    kept = docs.drop(*[x for x in docs.columns if x.lower() == "score"])
    return measure(kept, grammar, text).withColumn("score", 1 / (1 + F.exp(-line)))
