"""Url verdicts: host and path rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A vocabulary term counts where no letter or digit adjoins it. One strict term, or several distinct soft
terms, block a url. The automaton is built once per Python worker from the vocabulary (a parameter, so
bounded) and each url is scanned once however many terms there are.

Null urls and urls without ``://`` have an empty host and path, match no rule and are judged by their
whole text (null: allow). Repeated rows and ties are judged row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .text import ascii_lower, free_name

#: Fixed vocabulary of the default filter.
STRICT_TERMS = ("casino", "porn", "xxx", "viagra", "escort", "hentai", "camgirl", "warez")
SOFT_TERMS = ("win", "bet", "poker", "slots", "jackpot", "bonus", "lottery", "adult", "dating", "sexy", "nude",
              "pills", "loan", "crack", "torrent", "free")


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains if the url's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) up to / ? # and path up to ? #, both empty without a ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def best_rule(host: Column, path: Column, rules: list[Rule], field: str) -> Column:
    """``field`` of the longest rule that fits (the first given among equally long ones), or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def term_counts(strict: tuple[str, ...], soft: tuple[str, ...]):
    """A vectorised function: url -> (strict hits, distinct soft terms)."""
    terms = [(t.lower(), i, i < len(strict)) for i, t in enumerate((*strict, *soft)) if t]

    @F.pandas_udf("strict_hits int, soft_terms int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term, i, is_strict in terms:
            automaton.add_word(term, (len(term), i, is_strict))
        if terms:
            automaton.make_automaton()

        def scan(url):
            if not url or not terms:
                return 0, 0
            low, hits, softs = url.lower(), 0, set()
            for end, (size, i, is_strict) in automaton.iter(low):
                start = end - size + 1
                if (start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum()):
                    continue
                if is_strict:
                    hits += 1
                else:
                    softs.add(i)
            return hits, len(softs)

        for urls in batches:
            yield pd.DataFrame([scan(u) for u in urls], columns=["strict_hits", "soft_terms"])

    return count


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", strict: tuple[str, ...] = STRICT_TERMS,
          soft: tuple[str, ...] = SOFT_TERMS, soft_limit: int = 2) -> DataFrame:
    """Add host, path, rule, strict_hits, soft_terms and verdict; input columns of those names are replaced."""
    host, path = host_and_path(F.col(url))
    new = ["host", "path", "rule", "strict_hits", "soft_terms", "verdict"]
    kept = [c for c in pages.columns if c.lower() not in new]
    hits, host_, path_ = (free_name(pages, n) for n in ("_hits", "_host", "_path"))
    out = pages.withColumn(host_, host).withColumn(path_, path).withColumn(
        hits, term_counts(strict, soft)(F.col(url)))
    by_rule = best_rule(F.col(host_), F.col(path_), rules, "verdict")
    by_terms = F.when((F.col(hits)["strict_hits"] > 0) | (F.col(hits)["soft_terms"] >= soft_limit), "block").otherwise("allow")
    return out.select(
        *kept, F.col(host_).alias("host"), F.col(path_).alias("path"),
        best_rule(F.col(host_), F.col(path_), rules, "text").alias("rule"),
        F.col(hits)["strict_hits"].alias("strict_hits"), F.col(hits)["soft_terms"].alias("soft_terms"),
        F.coalesce(by_rule, by_terms).alias("verdict"))
