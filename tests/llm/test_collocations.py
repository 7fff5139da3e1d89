"""Collocations against brute force."""

import random
import re
from collections import Counter

import pytest

import awkward
from fieldloom.llm import collocations

lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(docs, longest, least, top, cover=100):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    good = {x: a for x, a in f.items() if a >= least}
    above = {}
    for (lang, p), a in good.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                key = lang, p[i:i + k]
                above[key] = max(above.get(key, 0), a)
    rows = {}
    for (lang, p), a in good.items():
        if len(p) < 2 or 100 * above.get((lang, p), -1) >= cover * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in rows.items()
            for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


def documents():
    rnd = random.Random(9)
    words = "new york city hall the of a Red red bus É é x\x1cy 漢 don't".split(" ")
    out = []
    for i in range(120):
        t = ""
        for _ in range(rnd.randrange(30)):
            t += rnd.choice(words) + rnd.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?"])
            if rnd.random() < 0.2:
                t += "the new york city hall of "
        out.append((rnd.choice(["en", "de", None, "und", ""]), t))
    return out + [("en", None), ("en", ""), ("en", " .,\n "), ("xx", "a b " * 3000), ("yy", "one two three four five six\n" * 9), out[0], out[0]]


@pytest.mark.parametrize("longest,least,top,held", [(5, 3, 2000, 10**6), (4, 5, 7, 10), (2, 2, 50, 3)])
def test_against_brute_force(spark, longest, least, top, held):
    docs = documents()
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = collocations.collocations(df, longest=longest, least=least, top=top, held=held).collect()
    want = brute(docs, longest, least, top)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_coverage_below_one(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "lang string, text string")
    got = collocations.collocations(df, least=3, cover=60).collect()
    assert {tuple(r) for r in got} == brute(docs, 5, 3, 2000, 60)


def test_many_elements_leave_a_task_in_parts(spark, monkeypatch):
    """Stripes of two-word phrases, cut in parts and flushed early, are whole after they are added up."""
    monkeypatch.setattr(collocations, "HELD_STRIPES", 5)
    monkeypatch.setattr(collocations, "PART", 10)
    docs = [("en", t) for _, t in documents()[:40]]
    df = spark.createDataFrame(docs, "lang string, text string").select("text", "lang").coalesce(1)
    found = collocations.candidates(df, 2, 1, 10**6)
    rows = collocations.merged(collocations.stripes(df, next(collocations.slices(found[1:], 10**6))), 1).collect()
    want = Counter()
    for _, t in docs:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(t)):
            w = re.findall("[^ \t]+", piece)
            want.update(zip(w, [*w[1:], None]))
    assert {(r.prefix, r.next): r.n for r in rows} == want


def test_no_frequent_phrase_is_missed_when_hashes_are_short(spark):
    """Phrases that share a hash only make the stripes larger."""
    docs = documents()
    df = spark.createDataFrame(docs, "lang string, text string").coalesce(1)
    got = collocations.collocations(df, least=3, bits=8).collect()
    assert {tuple(r) for r in got} == brute(docs, 5, 3, 2000)


def test_awkward_documents(spark):
    docs = [(r[2], r[1]) for r in awkward.rows(2000)]
    got = collocations.collocations(awkward.frame(spark, long_words=2000), least=2).collect()
    assert {tuple(r) for r in got} == brute(docs, 5, 2, 2000)
    assert collocations.collocations(awkward.empty(spark)).collect() == []
