"""Signature trees over token sets, and their dual traversal.

A set's signature is a bitmap with a bit per hashed token. A node holds the OR of its members' bitmaps, the
range of their sizes and the largest number of tokens that share a bit with another. Tokens common to a
member x of one node and y of another lie on bits set in both nodes, so

    overlap(x, y) <= popcount(OR_1 & OR_2) + collisions(x).

Node pairs whose bound stays under the overlap that a similarity of ``num / den`` asks of their least sizes
are pruned, and so are pairs whose size ranges cannot be similar. Nothing similar is ever pruned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FANOUT = 8
LEAST_BITS = 2048
BYTES_AT_ONCE = 1 << 23


def width_of(n: int) -> int:
    """Bits of the signature of a set of ``n`` tokens: a power of two, two to four per token, 2,048 at least.

    Small sets get many bits per token, so that hardly a pair passes by chance.
    """
    return max(LEAST_BITS, 1 << int(2 * n - 1).bit_length())


def signature(tokens: np.ndarray) -> bytes:
    bits = np.zeros(width_of(len(tokens)), bool)
    bits[(tokens % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Signatures of half the width: token t's bit t % w is also right modulo w / 2."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


@dataclass
class Level:
    bits: np.ndarray  # nodes x words of 64 bits
    least: np.ndarray  # smallest set
    most: np.ndarray  # largest set
    slack: np.ndarray  # most collisions


def build(bits: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """Levels from the leaves (the sets themselves, sorted by size) to a single root."""
    slack = sizes - np.bitwise_count(bits).sum(1).astype(np.int64)
    levels = [Level(bits, sizes, sizes, slack)]
    while len(levels[-1].least) > 1:
        below = levels[-1]
        cut = np.arange(0, len(below.least), FANOUT)
        levels.append(Level(
            np.bitwise_or.reduceat(below.bits, cut, 0), np.minimum.reduceat(below.least, cut),
            np.maximum.reduceat(below.most, cut), np.maximum.reduceat(below.slack, cut)))
    return levels


def possible(level: Level, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether members of nodes i and j can reach the similarity num / den."""
    big, small = np.maximum(level.least[i], level.least[j]), np.minimum(level.most[i], level.most[j])
    out = num * big <= den * small
    if out.any():
        at = np.flatnonzero(out)
        i, j = i[at], j[at]
        common = np.bitwise_count(level.bits[i] & level.bits[j]).sum(1).astype(np.int64)
        bound = common + np.minimum(level.slack[i], level.slack[j])
        out[at] = (num + den) * bound >= num * (level.least[i] + level.least[j])
    return out


def dual_traversal(levels: list[Level], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of leaves that no bound excludes; the frontier is expanded in parts of bounded size."""
    found = []
    most = max(64, BYTES_AT_ONCE // (8 * levels[0].bits.shape[1]))
    stack = [(len(levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        depth, i, j = stack.pop()
        if len(i) > most:
            for at in range(0, len(i), most):
                stack.append((depth, i[at:at + most], j[at:at + most]))
            continue
        keep = possible(levels[depth], i, j, num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if depth == 0:
            found.append((i, j))
            continue
        n = len(levels[depth - 1].least)
        step = np.arange(FANOUT)
        a = np.repeat((i[:, None] * FANOUT + step), FANOUT, 1).ravel()
        b = np.tile((j[:, None] * FANOUT + step), (1, FANOUT)).ravel()
        fits = (a < n) & (b < n) & ((a < b) if depth == 1 else (a <= b))
        stack.append((depth - 1, a[fits], b[fits]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def similar_candidates(sizes: np.ndarray, signatures: list[bytes], num: int, den: int) -> np.ndarray:
    """Pairs (rows of two places in the given lists) that may be similar; both places distinct, each pair once.

    Sets whose signatures have the same width form a tree together with those of twice the width, folded;
    similar sets never differ more than that if num / den is over a half.
    """
    widths = np.array([len(s) * 8 for s in signatures])
    out = []
    for width in np.unique(widths):
        same = np.flatnonzero(widths == width)
        wide = np.flatnonzero((widths == 2 * width) & (num * sizes <= den * sizes[same].max()))
        rows = [np.frombuffer(signatures[i], np.uint64) for i in same]
        bits = np.stack(rows)
        if len(wide):
            bits = np.vstack([bits, folded(np.stack([np.frombuffer(signatures[i], np.uint64) for i in wide]))])
        place = np.concatenate([same, wide])
        if len(place) < 2:
            continue
        order = np.argsort(sizes[place], kind="stable")
        i, j = dual_traversal(build(bits[order], sizes[place][order]), num, den)
        i, j = place[order[i]], place[order[j]]
        keep = (widths[i] == width) | (widths[j] == width)
        out.append(np.stack([np.minimum(i, j), np.maximum(i, j)], 1)[keep])
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)
