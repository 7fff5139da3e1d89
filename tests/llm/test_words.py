import re

import numpy as np
import pyarrow as pa

import awkward
from fieldloom.llm.words import LOWERED, PLAIN, shingle_sets, text_slices, windows, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    return [r[1] for r in awkward.rows(long_words=3000)]


def test_words_and_hashes_follow_the_definition():
    found = words_of(pa.array(texts()))
    by_word = {}
    for i, text in enumerate(texts()):
        want = WORD.findall(text or "")
        span = range(found.first[i], found.first[i + 1])
        assert [bytes(found.data[found.start[j]:found.end[j]]).decode() for j in span] == want
        for j, w in zip(span, want):
            assert by_word.setdefault(w, found.hash[j]) == found.hash[j]
    assert len(set(by_word.values())) == len(by_word)


def test_lower_case_is_ascii_only_and_punctuation_splits():
    plain = words_of(pa.array(["É A-b"]), PLAIN)
    assert [bytes(plain.data[a:b]).decode() for a, b in zip(plain.start, plain.end)] == ["É", "a", "b"]
    assert words_of(pa.array(["AbC"]), LOWERED).hash == words_of(pa.array(["aBc"]), LOWERED).hash


def test_slices_cover_all_rows_of_an_offset_array():
    array = pa.array(["x" * n for n in (0, 10, 500, 3, 3)] * 50).slice(7, 200)
    parts = list(text_slices(array, 600))
    assert [t for _, p in parts for t in p.to_pylist()] == array.to_pylist()
    assert [at for at, _ in parts] == list(np.r_[0, np.cumsum([len(p) for _, p in parts])[:-1]])
    assert list(text_slices(pa.array([], pa.string()))) == []


def test_shingles_against_sets_of_tuples():
    sample = ["a b c d e f a b c d e", "a b", "", None, "a b c d e"]
    sets = shingle_sets(words_of(pa.array(sample)))
    assert [len(s) for s in sets] == [6, 1, 0, 0, 1]
    assert sets[4][0] in sets[0] and sets[1][0] not in sets[0]
    assert len(windows(np.zeros(2, np.uint64), 3)) == 0
