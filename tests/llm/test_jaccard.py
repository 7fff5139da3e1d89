import random
import re
from itertools import combinations

import numpy as np
import pytest

import awkward
from fieldloom.llm.graph import components
from fieldloom.llm.jaccard_join import Similarity, _cut_block, jaccard_groups, keep_one
from fieldloom.llm.signature_tree import similar_candidates, signature


def shingles(text, k=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        common = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def families(seed):
    """Near copies at varied distances from a few bases, sharing passages, of varied lengths."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocab) for _ in range(30)]
    docs = []
    for _ in range(4):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([12, 40, 90, 200]))]
        for _ in range(22):
            words, edits = list(base), rnd.choice([0, 1, 1, 2, 3, 5])
            for _ in range(edits):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            if rnd.random() < 0.3:
                words = words + passage[:rnd.randrange(1, 30)]
            docs.append(" ".join(words))
    docs += [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 60))) + " " + " ".join(passage) for _ in range(12)]
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("sim", [Similarity(), Similarity(block=8, few=1, often=3, pivots=4), Similarity(block=6, few=1, often=10**9),
                                 Similarity(block=4, few=2, often=2, pivots=1)])
def test_groups_equal_brute_force_however_the_work_is_cut(spark, sim):
    docs = families(3)
    got = jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"), sim=sim)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs)


@pytest.mark.parametrize("sizes", [[100] * 4 + [400] * 5, [100] * 8 + [400] * 4, [10] * 4 + [100] * 4 + [1000] * 4, [100] * 6 + [400] * 6 + [2000]])
def test_all_pairs_of_a_long_list_meet_where_sizes_jump(sizes):
    sim, n = Similarity(block=8), np.array(sizes)
    blocks = [set(b.tolist()) for b in _cut_block(np.arange(len(n)), n, sim)]
    assert all(len(b) <= 8 for b in blocks)
    for i, j in combinations(range(len(n)), 2):
        assert 4 * n[i] < 3 * n[j] or any({i, j} <= b for b in blocks)


def test_a_list_whose_halves_are_like_no_other_keeps_its_links(spark):
    rnd = random.Random(4)
    docs = []
    for i, size in enumerate([20, 80, 320]):
        base = [f"t{i}_{rnd.randrange(10**6)}" for _ in range(size)]
        docs += [" ".join([*base, f"x{i}_{k}"]) for k in range(4)]
    docs = list(enumerate("a b c d e " + d for d in docs))
    got = jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string"), sim=Similarity(block=8, few=1, often=10**9))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs)


def test_awkward_documents(spark):
    docs = [(r[0], r[1]) for r in awkward.rows(long_words=5000)]
    got = jaccard_groups(awkward.frame(spark, long_words=5000))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs)
    kept = keep_one(awkward.frame(spark, long_words=5000))
    assert kept.columns == awkward.frame(spark).columns
    # 6, 7 and the null id go with 5, one of the two rows 8, and 12 with 11; texts without words stay
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 8, None, 9, 10, 11, 13, 14], key=str)
    assert jaccard_groups(awkward.empty(spark)).collect() == [] and keep_one(awkward.empty(spark)).collect() == []


def test_tree_never_prunes_a_similar_pair():
    rnd = np.random.default_rng(5)
    sets = []
    for _ in range(60):
        base = rnd.integers(0, 2**63, rnd.integers(3, 400), dtype=np.uint64)
        sets += [np.unique(base), np.unique(np.r_[base[: int(len(base) * rnd.uniform(0.7, 1))], rnd.integers(0, 2**63, 3, dtype=np.uint64)])]
    sizes = np.array([len(s) for s in sets])
    found = {tuple(p) for p in similar_candidates(sizes, [signature(s) for s in sets], 3, 4).tolist()}
    similar = {(i, j) for i, j in combinations(range(len(sets)), 2)
               if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))}
    assert similar <= found and len(found) < len(sets) * (len(sets) - 1) / 4


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (500, 499), (499, 500)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 499: 499, 500: 499}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
