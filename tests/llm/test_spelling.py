"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

import awkward
from fieldloom.llm import queries, spelling


def brute_words(docs, least=7, of=31):
    total = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % of == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(count):
    out = {}
    for w, n in count.items():
        near = [x for x in count if one_edit(w, x)]
        best = min(near, key=lambda x: (-count[x], x), default=None)
        out[w] = [best if best and count[best] >= 10 * n else None, n, len(near)]
    rows = set()
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, count[form] if form else None))
    return rows


def documents():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(5, 12))) for _ in range(60)]
    vocab += [w[:i] + rnd.choice("abcde×÷Éz") + w[i + rnd.randrange(2):] for w in vocab for i in (1, len(w) // 2, len(w) - 1)]
    vocab += [w[1] + w[0] + w[2:] for w in vocab[:20]]
    weights = [1000 // (1 + i % 60) ** 2 + 1 for i in range(len(vocab))]
    docs = [(i, " ".join(w.upper() if rnd.random() < 0.1 else w for w in rnd.choices(vocab, weights, k=150))) for i in range(150)]
    docs += [(300 + i, "zettelone " + "zettelones " * 15 + "zettelonest " * 200) for i in range(3)]
    return docs + [(None, " ".join(vocab)), (None, None), (1, ""), (1, docs[1][1]), (2, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001 + "1" + "x" * 5001)]


@pytest.mark.parametrize("part_bytes", [64, 1 << 16])
def test_against_brute_force(spark, part_bytes):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    words = spelling.count_words(df)
    want = brute_words(docs)
    assert {r.word: r.n for r in words.collect()} == want
    got = spelling.variant_groups(words, part_bytes=part_bytes).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == brute_groups(want)
    assert any(r.form and r.form != r.root for r in got)


def test_moves_hold_every_single_edit():
    moves = set(spelling._moves())
    number = lambda w: (len(w), *(sum(c in g for c in w) for g in spelling.GROUPS))
    rnd = random.Random(1)
    letters = "aeionstlmxz"
    for _ in range(2000):
        w = "".join(rnd.choice(letters) for _ in range(6))
        i = rnd.randrange(6)
        for v in (w[:i] + rnd.choice(letters) + w[i + 1:], w[:i] + rnd.choice(letters) + w[i:]):
            change = tuple(y - x for x, y in zip(number(w), number(v)))
            assert change in moves or tuple(-x for x in change) in moves


def test_awkward_documents(spark):
    docs = [(r[0], r[1]) for r in awkward.rows(3000)]
    words = spelling.count_words(awkward.frame(spark, long_words=3000), least_letters=3)
    assert {r.word: r.n for r in words.collect()} == brute_words(docs, 3)
    assert spelling.variant_groups(spelling.count_words(awkward.empty(spark))).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_words(docs)
    got = {r.word: r for r in queries.op13_spelling_variants(spark, sf_dir).collect()}
    assert {w: r.n for w, r in got.items()} == want
    if len(want) < 4000:
        assert {tuple(r) for r in got.values()} == brute_groups(want)
