"""Token counts that follow edits: only what an edit touches is encoded again.

A text is cut into leaves of about ``LEAF_CHARS`` characters, always before white space that follows another
character. The pre-tokenizer reads from left to right and no pre-token reaches over such a place, so the leaves'
token counts add up to the text's. The counts are the leaves of a segment tree kept per document.

Edits (start, end, replacement in code points of the old text) select the leaves they touch and one
neighbour on each side as context, so that the outer borders stay good places. The region is put together
anew, cut and encoded; the sums above it are updated, or the tree is rebuilt if it needs more leaves.

Definitions: a null text is empty and stays null without edits; edits are clipped to the text; of overlapping edits the one that
starts first (then ends first) counts; a null replacement deletes; null edits and nulls in start or end are
ignored; insertions (start = end) at one place are made in the order of their replacement.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import small_batches

LEAF_CHARS = 512
#: Before a blank or line feed that follows something else.
GOOD_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Fixed pre-token pattern of the vocabulary's family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EDITS = "array<struct<start:int,end:int,replacement:string>>"
STATE = "leaf_chars binary, tree binary"
_ENCODERS: dict[int, object] = {}


@dataclass(frozen=True)
class Vocabulary:
    """A ranks file (base64 token and rank a line), read by the driver and sent to the tasks."""

    ranks: bytes
    pattern: str = PATTERN

    @staticmethod
    def read(path: str, pattern: str = PATTERN) -> "Vocabulary":
        with open(path, "rb") as f:
            return Vocabulary(f.read(), pattern)

    def counter(self):
        """text -> number of tokens; one encoder per process and vocabulary."""
        key = hash((self.ranks, self.pattern))
        if key not in _ENCODERS:
            import tiktoken
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            _ENCODERS[key] = tiktoken.Encoding("edits", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        encode = _ENCODERS[key].encode_ordinary
        return lambda text: len(encode(text)) if text else 0


def cut(text: str) -> list[str]:
    """Leaves of a text; at least one, none of them empty unless the text is."""
    out, at = [], 0
    while len(text) - at > LEAF_CHARS:
        place = GOOD_CUT.search(text, at + LEAF_CHARS)
        if place is None:
            break
        out.append(text[at:place.start()])
        at = place.start()
    return [*out, text[at:]]


class SegmentTree:
    """Sums over leaves in heap order: node i has the children 2 i and 2 i + 1; leaves start at ``size``."""

    def __init__(self, leaves: np.ndarray):
        self.size = 1 << max(0, int(len(leaves) - 1).bit_length())
        self.node = np.zeros(2 * self.size, np.int64)
        self.node[self.size:self.size + len(leaves)] = leaves
        at = self.size
        while at > 1:
            half = at // 2
            self.node[half:at] = self.node[at:2 * at].reshape(-1, 2).sum(1)
            at = half

    @staticmethod
    def of(raw: bytes) -> "SegmentTree":
        tree = SegmentTree.__new__(SegmentTree)
        tree.node = np.frombuffer(raw, np.int64).copy()
        tree.size = len(tree.node) // 2
        return tree

    @property
    def total(self) -> int:
        return int(self.node[1])

    def put(self, first: int, leaves: np.ndarray) -> None:
        """Replace leaves and update the sums above them."""
        lo, hi = self.size + first, self.size + first + len(leaves)
        self.node[lo:hi] = leaves
        while lo > 1:
            lo, hi = lo // 2, (hi + 1) // 2
            self.node[lo:hi] = self.node[2 * lo:2 * hi].reshape(-1, 2).sum(1)


def build_one(text: str, count) -> tuple[np.ndarray, SegmentTree]:
    leaves = cut(text)
    return np.array([len(x) for x in leaves], np.int32), SegmentTree(np.array([count(x) for x in leaves], np.int64))


def clean_edits(edits, size: int) -> list[tuple[int, int, str]]:
    """Clipped, in order, without overlaps."""
    out, reach = [], 0
    usable = [e for e in edits or () if e is not None and e["start"] is not None and e["end"] is not None]
    for e in sorted(usable, key=lambda e: (e["start"], e["end"], e["replacement"] or "")):
        start, end = min(max(0, e["start"]), size), min(max(0, e["end"]), size)
        if start <= end and start >= reach:
            out.append((start, end, e["replacement"] or ""))
            reach = end
    return out


def edit_one(text: str, chars: np.ndarray, tree: SegmentTree, edits: list, count) -> tuple[str, np.ndarray, SegmentTree, int]:
    """(new text, new leaf lengths, tree, characters encoded again) after ``edits`` as of ``clean_edits``."""
    if not edits:
        return text, chars, tree, 0
    ends = np.cumsum(chars)
    starts = ends - chars
    full = np.flatnonzero(chars > 0)
    regions: list[list] = []
    for start, end, new in edits:
        if len(full):
            a = max(0, int(np.searchsorted(starts[full], start, "right")) - 2)
            b = min(len(full) - 1, int(np.searchsorted(ends[full], end, "left")) + 1)
            first, last = int(full[a]), int(full[b])
        else:
            first, last = 0, len(chars) - 1
        if regions and first <= regions[-1][1] + 1:
            regions[-1][1] = max(regions[-1][1], last)
            regions[-1][2].append((start, end, new))
        else:
            regions.append([first, last, [(start, end, new)]])
    pieces, at, again, grown = [], 0, 0, []
    for first, last, mine in regions:
        lo, hi = int(starts[first]), int(ends[last])
        parts, here = [], lo
        for start, end, new in mine:
            parts += [text[here:start], new]
            here = end
        fresh = "".join(parts) + text[here:hi]
        pieces += [text[at:lo], fresh]
        at, again = hi, again + len(fresh)
        leaves = cut(fresh)
        grown.append((first, last, np.array([len(x) for x in leaves], np.int32), np.array([count(x) for x in leaves], np.int64)))
    whole = "".join(pieces) + text[at:]
    if all(len(n) <= last - first + 1 for first, last, n, _ in grown):
        chars = chars.copy()
        for first, last, n, tokens in grown:
            spare = np.zeros(last - first + 1 - len(n), np.int64)
            chars[first:last + 1] = np.r_[n, spare]
            tree.put(first, np.r_[tokens, spare])
        return whole, chars, tree, again
    tokens = tree.node[tree.size:tree.size + len(chars)]
    new_chars, new_tokens, at = [], [], 0
    for first, last, n, t in grown:
        new_chars += [chars[at:first], n]
        new_tokens += [tokens[at:first], t]
        at = last + 1
    chars = np.concatenate([*new_chars, chars[at:]]).astype(np.int32)
    return whole, chars, SegmentTree(np.concatenate([*new_tokens, tokens[at:]])), again


# --- in Spark -----------------------------------------------------------------------------------
NEW = ("leaf_chars", "tree", "n_tokens", "text_hash", "n_edits", "reencoded_chars")


def build(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with leaf_chars and tree (the state), and n_tokens; columns of those names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in ("leaf_chars", "tree", "n_tokens")]
    small_batches(docs)
    wide = docs.select(*kept, F.lit(b"").alias("leaf_chars"), F.lit(b"").alias("tree"), F.lit(0).cast("long").alias("n_tokens"))
    held, at, columns = docs.sparkSession.sparkContext.broadcast(vocabulary), kept.index(text), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held.value.counter()
        for batch in batches:
            made = [build_one(t.as_py() or "", count) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:columns], pa.array([c.tobytes() for c, _ in made], pa.binary()),
                pa.array([t.node.tobytes() for _, t in made], pa.binary()),
                pa.array([t.total for _, t in made], pa.int64())], names=batch.schema.names)

    return wide.mapInArrow(run, wide.schema)


def apply_edits(state: DataFrame, vocabulary: Vocabulary, edits: str = "edits", text: str = "text") -> DataFrame:
    """New text and state of each row of ``state`` after its array of ``edits``, with n_edits and reencoded_chars."""
    kept = [c for c in state.columns if c.lower() not in ("n_edits", "reencoded_chars")]
    wide = state.select(*kept, F.lit(0).cast("long").alias("n_edits"), F.lit(0).cast("long").alias("reencoded_chars"))
    held, columns = state.sparkSession.sparkContext.broadcast(vocabulary), wide.columns
    use = {c: columns.index(c) for c in (text, edits, "leaf_chars", "tree", "n_tokens", "n_edits", "reencoded_chars")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = held.value.counter()
        for batch in batches:
            out = {c: [] for c in (text, "leaf_chars", "tree", "n_tokens", "n_edits", "reencoded_chars")}
            for t, e, c, n in zip(*(batch.column(use[x]).to_pylist() for x in (text, edits, "leaf_chars", "tree"))):
                clean = clean_edits(e, len(t or ""))
                new, chars, tree, again = edit_one(t or "", np.frombuffer(c, np.int32), SegmentTree.of(n), clean, count)
                row = (new if clean else t, chars.tobytes(), tree.node.tobytes(), tree.total, len(clean), again)
                for name, value in zip(out, row):
                    out[name].append(value)
            arrays = list(batch.columns)
            for name, values in out.items():
                arrays[use[name]] = pa.array(values, batch.schema.field(use[name]).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return wide.mapInArrow(run, wide.schema)
