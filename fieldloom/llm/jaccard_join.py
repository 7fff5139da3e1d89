"""Exact Jaccard self-join of word-shingle sets, as groups of linked documents, with signature trees.

1. One pass over the texts makes each document's set of shingle hashes, its signature bitmap and its
   prefix: sets that reach the similarity share a token among the first few of any common token order. The
   order here puts the tokens found often in a bounded sample last, so common passages are rarely in a
   prefix. Equal sets form a class, and only one document of a class goes on.
2. Prefix tokens are dealt by hash. Documents with a token in common form a block, cut to at most
   ``block`` members (two halves of every pair of parts, if it was larger).
3. Each block's members form a signature tree. Its dual traversal drops pairs whose overlap cannot suffice.
4. The rest is verified on whole sets. A block whose pairs are many first offers a few for each member; when
   the links found so far are joined to components, only pairs between different components are left.

Very large families of near copies consist of common tokens, which would put them all in one block.
Documents with such tokens in their prefix are first compared with a few pivots taken from them. Linked
ones then belong to the pivot's component. Distances obey the triangle inequality: a document of another
component similar to one at most 1 - s from a pivot is at most 2 (1 - s) from it. Only documents for
which such a pivot of another component exists still need their common tokens dealt.

Definitions: null and empty texts and texts of white space have an empty set and link with nothing; rows
equal in every respect are linked; a null id is never the smallest of a group that has another one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import stage
from .graph import components
from .signature_tree import signature, similar_candidates
from .text import small_batches
from .words import LOWERED, mixed, shingle_sets, text_slices, words_of

SAMPLE_DOCS = 8192
ENTRIES_PER_TASK = 1_000_000
BROADCAST_ROWS = 1_000_000
U = np.uint64


@dataclass(frozen=True)
class Similarity:
    """num / den as integers, so that the border is exact; over one half."""

    num: int = 3
    den: int = 4
    words: int = 5
    #: How the work is cut; no result depends on these: members of a block, pairs a member offers at first,
    #: documents of the sample that make a token common, pivots of a round.
    block: int = 1024
    few: int = 3
    often: int = 12
    pivots: int = 64

    def probe(self, n: int) -> int:
        """Prefix of a set of n tokens that meets every similar set of at most its size."""
        return n - -(-self.num * n // self.den) + 1

    def index(self, n: int) -> int:
        """Prefix that meets every similar set of at least its size."""
        return n - -(-2 * self.num * n // (self.num + self.den)) + 1

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def near(self, common, a, b):
        """At most twice the distance: similarity of at least 2 num / den - 1."""
        return self.den * common >= (2 * self.num - self.den) * (a + b - common)


def as_binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _common_tokens(docs: DataFrame, text: str, sim: Similarity) -> np.ndarray:
    """Sorted tokens in at least ``often`` documents of a sample of about ``SAMPLE_DOCS``.

    They only set the token order, which never changes a result. At most the sample's tokens divided
    by that number can qualify.
    """
    small_batches(docs)
    total = docs.count()
    keep = min(1.0, SAMPLE_DOCS / max(1, total))
    chosen = docs.select(F.col(text).alias("text")).filter(
        F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.lit(int(keep * 1_000_003) + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                sets = [s for s in shingle_sets(words_of(part, LOWERED), sim.words) if len(s)]
                if sets:
                    token, n = np.unique(np.concatenate(sets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    counts = chosen.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = [r["token"] for r in counts.filter(F.col("n") >= sim.often).select("token").collect()]
    return np.sort(np.array(found, np.int64).view(U))


def _is_member(values: np.ndarray, ordered: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Membership in a sorted array; ``low`` marks which low 20 bits occur, so most values stop there."""
    out = low[(values & U(0xFFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    if len(at):
        v = values[at]
        i = np.searchsorted(ordered, v)
        i[i == len(ordered)] = 0
        out[at] = ordered[i] == v
    return out


SETS = ("rid long, doc_id {}, text_hash long, n int, s1 long, s2 long, signature binary, cold binary, common binary, "
        "whole binary")


def document_sets(docs: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    """Sets of all documents: size, 128-bit identity, signature, prefix (cold and common part); the whole
    set where the prefix has common tokens."""
    common = _common_tokens(docs, text, sim)
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"),
                       F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(common)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = held.value
        low = np.zeros(1 << 20, bool)
        low[(common & U(0xFFFFF)).astype(np.int64)] = True
        for batch in batches:
            for at, part in text_slices(batch.column(3)):
                n, s1, s2, sig, cold, hot, whole = [], [], [], [], [], [], []
                for tokens in shingle_sets(words_of(part, LOWERED), sim.words):
                    size = len(tokens)
                    n.append(size)
                    if not size:
                        for column in (s1, s2, sig, cold, hot, whole):
                            column.append(None)
                        continue
                    s1.append(int(np.bitwise_xor.reduce(mixed(tokens)).view(np.int64)))
                    s2.append(int(mixed(tokens ^ U(0x5DEECE66D1234567)).sum().view(np.int64)))
                    sig.append(signature(tokens))
                    frequent = _is_member(tokens, common, low)
                    rare = tokens[~frequent][:sim.probe(size)]
                    often = tokens[frequent][:sim.probe(size) - len(rare)]
                    cold.append(as_binary(rare))
                    hot.append(as_binary(often))
                    whole.append(as_binary(tokens) if len(often) else None)
                size = len(part)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(i).slice(at, size) for i in range(3)), pa.array(n, pa.int32()),
                    pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                    *(pa.array(c, pa.binary()) for c in (sig, cold, hot, whole))],
                    ["rid", "doc_id", "text_hash", "n", "s1", "s2", "signature", "cold", "common", "whole"])

    return rows.mapInArrow(make, SETS.format(kind))


# --- families of common tokens -----------------------------------------------------------------
def _choose_pivots(hot: DataFrame, sim: Similarity) -> dict[int, np.ndarray]:
    """Up to ``pivots`` mutually unlinked sets among a bounded random draw of ``hot`` (rid, whole)."""
    drawn = hot.orderBy(F.xxhash64("rid")).limit(8 * sim.pivots).collect()
    chosen: dict[int, np.ndarray] = {}
    for row in drawn:
        tokens = np.frombuffer(row["whole"], U)
        if len(chosen) < sim.pivots and not any(
                sim.linked(len(np.intersect1d(tokens, p, True)), len(tokens), len(p)) for p in chosen.values()):
            chosen[row["rid"]] = tokens
    return chosen


def _against_pivots(hot: DataFrame, pivots: dict[int, np.ndarray], sim: Similarity) -> DataFrame:
    """(rid, pivot, linked) for every document near a pivot; a pivot is linked with itself."""
    ids = np.array(list(pivots), np.int64)
    sizes = np.array([len(p) for p in pivots.values()])
    token = np.concatenate(list(pivots.values()))
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(token, kind="stable")
    held = hot.sparkSession.sparkContext.broadcast((token[order], owner[order]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, owner = held.value
        for batch in batches:
            rid, pivot, linked = [], [], []
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = np.frombuffer(raw.as_py(), U)
                lo, hi = np.searchsorted(token, tokens), np.searchsorted(token, tokens, "right")
                size = hi - lo
                at = np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                common = np.bincount(owner[at], minlength=len(ids))
                for p in np.flatnonzero(sim.near(common, len(tokens), sizes) & (common > 0)):
                    rid.append(r)
                    pivot.append(int(ids[p]))
                    linked.append(bool(sim.linked(common[p], len(tokens), sizes[p])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(pivot, pa.int64()), pa.array(linked, pa.bool_())], ["rid", "pivot", "linked"])

    return hot.mapInArrow(compare, "rid long, pivot long, linked boolean")


def pivot_links(sets: DataFrame, sim: Similarity, rounds: int = 4) -> tuple[DataFrame | None, DataFrame]:
    """Links with pivots (a, b), or None, and the rids whose common tokens must still be dealt."""
    hot = stage(sets.filter(F.col("whole").isNotNull()).select("rid", "whole"), "hot-sets")
    near, rest = None, hot
    for _ in range(rounds):
        if rest.count() <= sim.block:
            break
        found = stage(_against_pivots(hot, _choose_pivots(rest, sim), sim), "pivots")
        near = found if near is None else near.unionByName(found)
        rest = stage(rest.join(found.filter("linked").select("rid"), "rid", "left_anti"), "unlinked")
    if near is None:
        return None, hot.select("rid")
    links = near.filter("linked").select(F.col("rid").alias("a"), F.col("pivot").alias("b"))
    roots = components(links).unionByName(near.filter("linked AND rid = pivot").select(
        F.col("rid").alias("node"), F.col("pivot").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
    roots = stage(roots, "pivot-roots")
    other = near.filter("NOT linked").join(roots.withColumnsRenamed({"node": "pivot", "root": "to"}), "pivot").join(
        roots.withColumnsRenamed({"node": "rid", "root": "from"}), "rid", "left")
    # near a pivot of another component, or in no component
    outside = stage(other.filter("from IS NULL OR from != to").select("rid", "from", "to"), "outside")
    seen = outside.select("rid").unionByName(rest.select("rid"))
    # documents of a component that an unlinked document is near to
    open_roots = outside.filter("from IS NULL").select(F.col("to").alias("root")).distinct()
    seen = seen.unionByName(roots.join(open_roots, "root", "left_semi").select(F.col("node").alias("rid")))
    return links, seen.distinct()


# --- blocks ------------------------------------------------------------------------------------
def _deal(reps: DataFrame, sim: Similarity, buckets: int) -> DataFrame:
    """(bucket, entries): prefix entries packed by bucket. An entry is token (63 bits), index flag, size, rid."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0

        def flush():
            token = np.concatenate([p[0] for p in pending])
            size = np.concatenate([np.full(len(p[0]), p[1], np.int64) for p in pending])
            rid = np.concatenate([np.full(len(p[0]), p[2], np.int64) for p in pending])
            bucket = (token >> U(24)) % U(buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, token, size, rid = bucket[order], token[order], size[order], rid[order]
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            entries = [as_binary(token[a:b]) + as_binary(size[a:b].astype(np.int32)) + as_binary(rid[a:b])
                       for a, b in zip(cut, np.r_[cut[1:], len(bucket)])]
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut].astype(np.int32)), pa.array(entries, pa.binary())], ["bucket", "entries"])

        for batch in batches:
            for rid, n, cold, hot in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tokens = np.frombuffer(cold + (hot or b""), U)
                flagged = (tokens & ~U(1)) | (np.arange(len(tokens)) < sim.index(n)).astype(U)
                pending.append((flagged, n, rid))
                held += len(tokens)
                if held >= 1 << 18:
                    yield flush()
                    pending, held = [], 0
        if held:
            yield flush()

    return reps.select("rid", "n", "cold", "common").mapInArrow(pack, "bucket int, entries binary")


def _cut_block(rids: np.ndarray, sizes: np.ndarray, sim: Similarity) -> Iterator[np.ndarray]:
    """Blocks of at most ``block`` members in which all pairs of similar size meet."""
    if len(rids) <= sim.block:
        yield rids
        return
    order = np.argsort(sizes, kind="stable")
    rids, sizes, half = rids[order], sizes[order], sim.block // 2
    starts = range(0, len(rids), half)
    met = 0  # halves before this place were in a block
    for i in starts:
        top = sizes[min(i + half, len(rids)) - 1]
        for j in starts:
            if j > i and sim.num * sizes[j] <= sim.den * top:
                met = max(met, j + half)
                yield np.concatenate([rids[i:i + half], rids[j:j + half]])
        if met <= i:  # like no other half in size
            met = i + half
            yield rids[i:i + half]


def blocks_of(reps: DataFrame, sim: Similarity) -> DataFrame:
    """(members array<long>): different lists of documents that share a prefix token and may be similar in size."""
    spark = reps.sparkSession
    entries = reps.agg(F.sum(F.octet_length("cold") + F.octet_length(F.coalesce("common", F.lit(b""))))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // 8 // ENTRIES_PER_TASK + 1)
    dealt = _deal(reps, sim, 16 * tasks).repartition(tasks, "bucket").select("entries")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, size, rid = [], [], []
        for batch in batches:
            for raw in batch.column(0):
                raw = raw.as_buffer()
                n = raw.size // 20
                token.append(np.frombuffer(raw, U, n))
                size.append(np.frombuffer(raw, np.int32, n, 8 * n))
                rid.append(np.frombuffer(raw, np.int64, n, 12 * n))
        if not token:
            return
        token, size, rid = np.concatenate(token), np.concatenate(size).astype(np.int64), np.concatenate(rid)
        order = np.argsort(token >> U(1), kind="stable")
        token, size, rid = token[order], size[order], rid[order]
        flag = (token & U(1)).astype(bool)
        token = token >> U(1)
        cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        count = np.diff(np.r_[cut, len(token)])
        seen: set[bytes] = set()
        a = cut[count == 2]  # most lists are pairs, handled at once
        b = a + 1
        small = np.where(size[a] <= size[b], a, b)
        big = a + b - small
        ok = (sim.num * size[big] <= sim.den * size[small]) & (flag[small] | ((size[a] == size[b]) & flag[big]))
        pairs = np.stack([np.minimum(rid[a], rid[b]), np.maximum(rid[a], rid[b])], 1)[ok]
        pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
        if len(pairs):
            yield _lists([p for p in pairs])
        out = []
        for at, n in zip(cut[count > 2], count[count > 2]):
            r, s = rid[at:at + n], size[at:at + n]
            if not flag[at:at + n].any():
                continue
            for block in _cut_block(r, s, sim):
                key = as_binary(np.sort(block))
                if key not in seen:
                    seen.add(key)
                    out.append(np.frombuffer(key, np.int64))
            if len(out) > 1000:
                yield _lists(out)
                out = []
        if out:
            yield _lists(out)

    return dealt.mapInArrow(group, "members array<long>")


def _lists(rows: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["members"])


def _candidates(blocks: DataFrame, reps: DataFrame, sim: Similarity, roots: DataFrame | None) -> DataFrame:
    """(a, b, open): pairs that the blocks' signature trees leave.

    Without ``roots`` a block with many pairs gives few of each member's and marks them open; with
    ``roots`` (node, root) it gives all pairs between different components.
    """
    info = reps.select("rid", "n", "signature")
    if roots is not None:
        info = info.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    else:
        info = info.withColumn("root", F.col("rid"))
    each = blocks.select("block", F.explode("members").alias("rid")).join(info, "rid")
    grouped = each.groupBy("block").agg(F.collect_list(F.struct("rid", "n", "signature", "root")).alias("m")).select("m")
    first = roots is None

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, still = [], [], []
            for members in batch.column(0):
                m = members.values
                rid, size = m.field("rid").to_numpy(), m.field("n").to_numpy().astype(np.int64)
                root = m.field("root").to_numpy()
                pairs = similar_candidates(size, m.field("signature").to_pylist(), sim.num, sim.den)
                pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
                many = first and len(pairs) > sim.few * len(rid)
                if many:  # neighbours in a ring over the members, and whatever stands first for each
                    hub = np.bincount(pairs.ravel(), minlength=len(rid)).argmax()
                    with_hub = (pairs == hub).any(1)
                    _, one = np.unique(pairs[:, 0], return_index=True)
                    _, two = np.unique(pairs[:, 1], return_index=True)
                    pairs = pairs[np.unique(np.r_[np.flatnonzero(with_hub), one, two])]
                left.append(rid[pairs[:, 0]])
                right.append(rid[pairs[:, 1]])
                still.append(np.full(len(pairs), many))
            a, b = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.concatenate(still))], ["a", "b", "open"])

    return grouped.mapInArrow(traverse, "a long, b long, open boolean")


def _verified(pairs: DataFrame, whole: DataFrame, sim: Similarity) -> DataFrame:
    """The pairs (a, b) whose sets are similar; ``whole`` has (rid, tokens)."""
    left = whole.select(F.col("rid").alias("a"), F.col("tokens").alias("x"))
    right = whole.select(F.col("rid").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                keep.append(bool(sim.linked(len(np.intersect1d(x, y, True)), len(x), len(y))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(test, "a long, b long")


def _whole_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    """(rid, tokens) of the wanted rids, made from their texts again."""
    keys = stage(reps.join(wanted, "rid", "left_semi").select("rid", F.col("doc_id").alias("i"), F.col("text_hash").alias("h")), "wanted")
    small = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    source = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    texts = source.join(small, (F.col("th") == F.col("h")) & F.col("d").eqNullSafe(F.col("i"))).select("rid", "text")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in text_slices(batch.column(1)):
                sets = [as_binary(s) for s in shingle_sets(words_of(part, LOWERED), sim.words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array(sets, pa.binary())], ["rid", "tokens"])

    return texts.mapInArrow(make, "rid long, tokens binary").dropDuplicates(["rid"])


# --- the operator ------------------------------------------------------------------------------
def linked_sets(docs: DataFrame, doc_id: str, text: str, sim: Similarity) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, text_hash, n and the root (a rid) of its group, null for an empty set."""
    sets = stage(document_sets(docs, doc_id, text, sim), "sets")
    classes = stage(sets.filter("n > 0").groupBy("s1", "s2").agg(F.min("rid").alias("rid")), "classes")
    copies = stage(sets.filter("n > 0").select("rid").join(classes.select("rid"), "rid", "left_anti"), "copies")
    reps = sets.filter("n > 0").join(copies, "rid", "left_anti")
    links, dealt = pivot_links(reps, sim)
    needed = stage(dealt, "dealt")
    quiet = reps.filter(F.col("whole").isNotNull()).select("rid").join(needed, "rid", "left_anti")
    quiet = stage(quiet.withColumn("quiet", F.lit(True)), "quiet")
    to_deal = reps.join(quiet, "rid", "left").withColumn("common", F.when(F.col("quiet").isNull(), F.col("common")))
    lists = blocks_of(to_deal, sim)
    blocks = stage(lists.distinct().withColumn("block", F.monotonically_increasing_id()), "blocks")
    first = stage(_candidates(blocks, reps, sim, None), "candidates")
    pairs = first.select("a", "b").distinct()
    whole = stage(_whole_sets(docs, reps, _ends(pairs), doc_id, text, sim), "whole")
    found = stage(_verified(pairs, whole, sim), "links")
    found = found if links is None else found.unionByName(links)
    roots = stage(components(found), "components")
    if first.filter("open").limit(1).count():
        more = _candidates(blocks, reps, sim, roots).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
        more = stage(more, "candidates")
        ends = _ends(more).join(whole.select("rid"), "rid", "left_anti")
        both = whole.unionByName(stage(_whole_sets(docs, reps, ends, doc_id, text, sim), "whole"))
        extra = stage(_verified(more, both, sim), "links")
        known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = stage(components(known.unionByName(extra)), "components")
    labelled = classes.join(roots.select(F.col("node").alias("rid"), "root"), "rid", "left")
    labelled = labelled.select("s1", "s2", F.coalesce("root", "rid").alias("root"))
    return sets.select("rid", "doc_id", "text_hash", "n", "s1", "s2").join(labelled, ["s1", "s2"], "left").drop("s1", "s2")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sim: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links), one row per row of ``docs``."""
    linked = stage(linked_sets(docs, doc_id, text, sim), "linked")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "of")
    return linked.join(least, F.col("root") == F.col("of"), "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sim: Similarity = Similarity()) -> DataFrame:
    """``docs`` with one row of each group, the one of the smallest id (null last), and all rows of empty sets."""
    linked = stage(linked_sets(docs, doc_id, text, sim).filter("n > 0"), "linked")
    rank = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("rid").alias("c"))
    stays = linked.groupBy("root").agg(F.min(rank)["c"].alias("rid")).withColumn("stays", F.lit(1)).select("rid", "stays")
    keys = linked.join(stays, "rid", "left").groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.coalesce("stays", F.lit(0))).alias("stays"))
    keys = stage(keys.filter("stays = 0 OR rows > 1").withColumnsRenamed({"doc_id": "i", "text_hash": "h"}), "dropped")
    of = F.col(doc_id).eqNullSafe(F.col("i")) & (F.xxhash64(F.col(text)) == F.col("h"))
    kept = docs.join(keys.select("i", "h"), of, "left_anti")
    repeated = keys.filter("stays = 1").select("i", "h")
    if repeated.limit(1).count():
        kept = kept.unionByName(docs.join(repeated, of, "left_semi").dropDuplicates([doc_id, text]))
    return kept
