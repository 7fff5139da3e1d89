"""Word and shingle hashes of Arrow text batches, computed with numpy over slices of about half a megabyte.

A word is a run without ASCII white space. Its 64-bit hash is a mixed difference of running sums of
byte values times powers of an odd number, so no Python code runs per word. Equal words have equal
hashes; different ones differ but for a chance near 2**-60 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=U) * U(2) + U(1)
PLACE = _RANDOM.integers(1, 2**63, 64, dtype=U) * U(2) + U(1)
LENGTH_TAG = _RANDOM.integers(1, 2**63, 64, dtype=U)
BASE = U(0x9E3779B97F4A7C15)
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Lower-cased, ASCII punctuation as white space.
PLAIN = LOWERED.copy()
PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32
_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest table is kept."""
    table = _POWERS.get(int(base))
    if table is None or len(table) < n:
        table = np.full(max(n, SLICE_BYTES + 1024), base, U)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= 4 * SLICE_BYTES:
            _POWERS[int(base)] = table
    return table[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of some texts in order: byte offsets in ``data``, hashes, and each text's range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more than texts
    offsets: np.ndarray  # byte offsets of the texts, one more than texts
    sums: np.ndarray  # running sums over the bytes

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; a word's range has the word's hash."""
        return mixed((self.sums[end] - self.sums[start]) * powers(BASE_INVERSE, len(self.sums))[start])

    def __len__(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(row, part) pieces of an array of texts, each of about ``most`` bytes, at least one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = byte_offsets(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def byte_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(1, np.int64)
    found = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1]
    return found.astype(np.int64)


def words_of(texts: pa.Array, bytes_as: np.ndarray | None = None) -> Words:
    """Words of each text; a null text has none. ``bytes_as`` (LOWERED, PLAIN) replaces each byte first."""
    offsets = byte_offsets(texts)
    raw = texts.buffers()[2] if len(texts) else None
    base = offsets[0]
    offsets = offsets - base
    size = int(offsets[-1])
    data = np.frombuffer(raw, np.uint8, size, int(base)) if raw is not None and size else np.zeros(0, np.uint8)
    if bytes_as is not None:
        data = bytes_as[data]
    space = IS_SPACE[data]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before = np.ones(size, bool)
    before[1:] = space[:-1]
    after = np.ones(size, bool)
    after[:-1] = space[1:]
    start = np.flatnonzero(~space & (before | edge[:-1]))
    end = np.flatnonzero(~space & (after | edge[1:])) + 1
    sums = np.zeros(size + 1, U)
    np.cumsum(BYTE_VALUE[data] * powers(BASE, size), out=sums[1:])
    found = Words(data, start, end, start, np.searchsorted(start, offsets), offsets, sums)
    found.hash = found.span_hash(start, end)
    return found


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, regardless of text borders."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, LENGTH_TAG[k], U)
    for i in range(k):
        total += hashes[i:i + n] * PLACE[i]
    return mixed(total)


def shingle_sets(words: Words, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word runs; a shorter text gives its whole run as one."""
    grams = windows(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            out.append(np.unique(grams[a:b - k + 1]))
        elif b > a:
            out.append(windows(words.hash[a:b], int(b - a)))
        else:
            out.append(np.zeros(0, U))
    return out
