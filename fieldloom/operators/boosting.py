"""Boosted trees on coded features: many fits side by side, one in a task.

Features are coded once per group: ``feature_cuts`` takes cuts from all its rows and ``coded`` puts a byte in
place of each number, so a fit reads one byte a feature and no task holds the numbers of all rows. ``fit_trees`` fits every
group of a keyed table in a task of its own, which holds up to TASK_CELLS codes; larger groups are fitted by all tasks together
(``hurdle.fit_spread``), so rows are never left out. A fit stops by itself once ``patience`` rounds have passed without a better one
on the validation rows and returns the nodes of the trees up to the best round; nothing is fitted twice. The node table
is the model: ``scores`` reads it back for rows of any number.

A row goes left when its number is at most the threshold; a missing number goes right. A model is the sum of its trees,
the first of which is a single leaf with the starting value.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Codes (rows times features, a byte each) of a group that a task holds at most.
TASK_CELLS = 200_000_000
#: Features that one aggregation takes cuts of where a group has more rows than a task holds.
SKETCHED = 64
#: Cells (rows times features, or rows times trees) that are worked on at once.
CELLS = 4_000_000
NODE = "tree int, node int, feature int, threshold double, gain double, rows long, prediction double, left int, right int"
NODE_COLUMNS = [part.split()[0] for part in NODE.split(", ")]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as rows of a matrix; missing numbers are NaN."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def shape(rows: DataFrame, by: str) -> tuple[int, int]:
    """Rows of the largest group and the length of ``x``."""
    most = rows.groupBy(by).count().agg(F.max("count")).first()[0]
    return (most, rows.select(F.size("x")).first()[0]) if most else (0, 0)


def feature_cuts(rows: DataFrame, by: str, order: list[str], bins: int) -> dict:
    """Per value of ``by`` and feature of ``x`` at most ``bins`` - 1 increasing cuts, quantiles of all rows.

    They are exact, and the same for rows in any order, unless a group has more numbers than a task holds. Then they come from
    sketches of all rows, whose ranks are right to one in 10,000.
    """
    n, features = shape(rows, by)
    kind = rows.schema[by].dataType.simpleString()
    if n * features > TASK_CELLS:
        return _sketched_cuts(rows, by, features, bins)
    width = max(1, CELLS // max(1, n))
    number = np.float32 if rows.schema["x"].dataType.elementType.simpleString() == "float" else np.float64

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, groups = matrix(batch.column(1)).astype(number), batch.column(0).to_numpy(zero_copy_only=False)
            for g in np.unique(groups):
                mine = x[groups == g]
                parts = [np.ascontiguousarray(mine[:, i:i + width].T).tobytes() for i in range(0, x.shape[1], width)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([g] * len(parts), batch.column(0).type), pa.array(range(0, x.shape[1], width), pa.int32()),
                    pa.array(parts, pa.binary())], [by, "first", "part"])

    def cuts(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        wide = min(width, features - key[1])
        x = np.concatenate([np.frombuffer(part, number).reshape(wide, -1) for part in group["part"]], axis=1).astype(np.float64)
        found = []
        for column in x:
            known = column[~np.isnan(column)]
            q = np.unique(np.quantile(known, np.arange(1, bins) / bins, method="lower")) if len(known) else known
            found.append(q[q < known.max()] if len(known) else q)
        return pd.DataFrame({by: key[0], "at": np.arange(key[1], key[1] + wide, dtype=np.int32), "cuts": found})

    dealt = rows.select(by, "x").mapInArrow(pieces, f"{by} {kind}, first int, part binary")
    table = dealt.groupBy(by, "first").applyInPandas(cuts, f"{by} {kind}, at int, cuts array<double>")
    out: dict = {}
    for r in table.orderBy(by, "at").toLocalIterator():  # groups x features x bins numbers
        out.setdefault(r[by], []).append(np.array(r["cuts"], dtype=np.float64))
    return out


def _sketched_cuts(rows: DataFrame, by: str, features: int, bins: int) -> dict:
    probs = [i / bins for i in range(1, bins)]
    out: dict = {}
    for first in range(0, features, SKETCHED):
        at = range(first, min(first + SKETCHED, features))
        value = {i: F.when(~F.isnan(F.get("x", F.lit(i))), F.get("x", F.lit(i)).cast("double")) for i in at}
        aggs = [F.percentile_approx(value[i], probs, 10_000).alias(f"q{i}") for i in at] + [F.max(value[i]).alias(f"m{i}") for i in at]
        for r in rows.groupBy(by).agg(*aggs).collect():  # a row for each group
            for i in at:
                q = np.unique(np.array(r[f"q{i}"] or [], dtype=np.float64))
                out.setdefault(r[by], []).append(q[q < r[f"m{i}"]] if len(q) else q)
    return out


def coded(rows: DataFrame, by: str, cuts: dict) -> DataFrame:
    """``rows`` with ``codes`` (a byte for each feature: the number of cuts below it) in place of ``x``."""
    keep = [c for c in rows.columns if c != "x"]
    at = keep.index(by)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, groups = matrix(batch.column("x")), batch.column(at).to_numpy(zero_copy_only=False)
            out = np.zeros(x.shape, dtype=np.uint8)
            for g in np.unique(groups):
                mine = np.flatnonzero(groups == g)
                for j, c in enumerate(cuts[g]):
                    out[mine, j] = np.searchsorted(c, x[mine, j])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([r.tobytes() for r in out], pa.binary())], [*keep, "codes"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", codes binary"
    return rows.select(*keep, "x").mapInArrow(code, schema)


def _histograms(columns: list[np.ndarray], at: np.ndarray, slot: np.ndarray, weights: list, nodes: int, bins: int) -> np.ndarray:
    """Sums of each weight by node, feature and code over the rows ``at``, which lie in the nodes ``slot``; a weight of None counts rows.

    Feature by feature, so that the sums of a feature stay in the processor's cache.
    """
    out = np.zeros((len(weights), nodes, len(columns), bins))
    for i in range(0, len(at), CELLS):
        part = at[i:i + CELLS]
        base, own = slot[i:i + CELLS] * bins, [None if w is None else w[part] for w in weights]
        for j, column in enumerate(columns):
            key = base + column[part]
            for k, w in enumerate(own):
                out[k, :, j] += np.bincount(key, w, nodes * bins).reshape(nodes, bins)
    return out


def _walk(tree: dict, codes: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    node = np.zeros(len(codes), dtype=np.int64)
    rows = np.arange(len(codes))
    for _ in range(tree["depth"]):
        right = codes[rows, tree["feature"][node]] > tree["code"][node]
        node = np.where(right, tree["right"][node], tree["left"][node])
    return node


def grow(codes: np.ndarray, g: np.ndarray, h: np.ndarray | None, bins: int, s, columns: np.ndarray) -> dict:
    """One tree for the gradients ``g``, level by level; ``h`` of None stands for ones.

    A split has the largest gain of squared sums over both sides, each of ``min_rows`` rows; ties go to the first
    feature and cut.
    """
    feature, code, gain, left, right, rows = [0], [255], [0.0], [0], [0], [len(g)]
    node_of, live, depth = np.zeros(len(g), dtype=np.int64), np.array([0]), 0
    sub = [np.ascontiguousarray(codes[:, j]) for j in columns]
    weights = [None, g] + ([] if h is None else [h])
    at = np.arange(len(g))
    sums = None
    while depth < s.depth and bins > 1:
        if sums is None:
            sums = _histograms(sub, at, node_of, weights, 1, bins)
        else:
            # Only the smaller child of a split is summed up; its sibling is the rest of the parent.
            pairs = live.reshape(-1, 2)
            counts = np.array(rows)[pairs]
            small = pairs[np.arange(len(pairs)), counts.argmin(axis=1)]
            slots = np.full(len(feature), -1)
            slots[small] = np.arange(len(small))
            of = slots[node_of[at]]
            part = _histograms(sub, at[of >= 0], of[of >= 0], weights, len(small), bins)
            first = (small == pairs[:, 0])[None, :, None, None]
            other = sums - part
            sums = np.stack([np.where(first, part, other), np.where(first, other, part)], axis=2).reshape(
                len(weights), len(live), len(sub), bins)
        below = sums.cumsum(axis=3)
        whole = below[..., -1:]
        low, high = below[..., :-1], whole - below[..., :-1]
        fits = (low[0] >= s.min_rows) & (high[0] >= s.min_rows)
        weight = lambda side: np.maximum(side[0 if h is None else 2], 1e-12)
        better = low[1] ** 2 / weight(low) + high[1] ** 2 / weight(high) - whole[1] ** 2 / weight(whole)
        better = np.where(fits, better, -np.inf).reshape(len(live), -1)
        best = better.argmax(axis=1)
        grown, split = [], []
        for k, node in enumerate(live):
            if not better[k, best[k]] > 1e-9:
                continue
            j, c = divmod(int(best[k]), bins - 1)
            feature[node], code[node], gain[node] = int(columns[j]), c, float(better[k, best[k]])
            left[node], right[node] = len(feature), len(feature) + 1
            for side in (low, high):
                feature.append(0), code.append(255), gain.append(0.0)
                left.append(len(left)), right.append(len(right)), rows.append(int(side[0, k, j, c]))
            grown += [left[node], right[node]]
            split.append(k)
        if not grown:
            break
        f, c, lf, rt = (np.array(v) for v in (feature, code, left, right))
        at = at[lf[node_of[at]] != node_of[at]]
        node = node_of[at]
        node_of[at] = np.where(codes[at, f[node]] > c[node], rt[node], lf[node])
        live, depth, sums = np.array(grown), depth + 1, sums[:, split]
    return dict(feature=np.array(feature), code=np.array(code), gain=np.array(gain), left=np.array(left),
                right=np.array(right), rows=np.array(rows), depth=depth, node_of=node_of)


class _Rows:
    """Some rows of a matrix of codes, taken column by column as they are asked for."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        self.codes, self.rows = codes, rows

    def __getitem__(self, key: tuple) -> np.ndarray:
        at, feature = key
        return self.codes[self.rows if isinstance(at, slice) else self.rows[at], feature]


def _share(rule: str, features: int) -> int:
    return features if rule == "all" else max(1, int(np.ceil(float(rule) * features)))


def fit(codes: np.ndarray, y: np.ndarray, is_val: np.ndarray, kind: str, s, cuts: list) -> pd.DataFrame:
    """Nodes of the boosted trees up to the best round.

    ``kind`` absolute: mean absolute error, leaves are medians of residuals; logistic: log loss of labels 0 and 1, leaves
    are Newton steps. The start counts as a round: where no tree does better on the validation rows, it is the model, as it is
    with labels of one class. Without validation rows all ``rounds`` are kept.
    """
    rng = np.random.default_rng(s.seed)
    train = np.flatnonzero(~is_val)
    held = np.flatnonzero(is_val)
    bins = max([len(c) for c in cuts], default=0) + 1
    absolute = kind == "absolute"
    if absolute:
        start = float(np.median(y[train])) if len(train) else 0.0
    else:
        share = float(y[train].mean()) if len(train) else 0.5
        with np.errstate(divide="ignore"):
            start = float(np.log(share) - np.log1p(-share))
    out = np.full(len(y), start)
    trees: list[dict] = []
    def error() -> float:
        if absolute:
            return float(np.abs(y[held] - out[held]).mean())
        return float(np.logaddexp(0, np.where(y[held] > 0, -out[held], out[held])).mean())

    best, least = 0, error() if len(held) else np.inf
    for number in range(1, s.rounds + 1) if np.isfinite(start) and len(train) else ():
        rows = train if s.subsample >= 1 else train[rng.random(len(train)) < s.subsample]
        columns = np.sort(rng.choice(len(cuts), _share(s.features, len(cuts)), replace=False))
        mine = _Rows(codes, rows)
        if absolute:
            residual = y[rows] - out[rows]
            tree = grow(mine, np.sign(residual), None, bins, s, columns)
            values = pd.Series(residual).groupby(tree["node_of"]).median()
        else:
            p = 1 / (1 + np.exp(-out[rows]))
            g, h = y[rows] - p, np.maximum(p * (1 - p), 1e-12)
            tree = grow(mine, g, h, bins, s, columns)
            leaves = np.unique(tree["node_of"])
            total = [np.bincount(tree["node_of"], v)[leaves] for v in (g, h)]
            values = pd.Series(total[0] / total[1], index=leaves)
        tree["value"] = np.zeros(len(tree["feature"]))
        tree["value"][values.index.to_numpy()] = s.step * values.to_numpy()
        out += tree["value"][_walk(tree, codes)]
        del tree["node_of"]
        trees.append(tree)
        if len(held):
            now = error()
            if now < least:
                best, least = number, now
            elif number - best >= s.patience:
                break
        else:
            best = number
    return _nodes(start, len(train), trees[:best], cuts)


def _nodes(start: float, rows: int, trees: list[dict], cuts: list) -> pd.DataFrame:
    parts = [pd.DataFrame([(0, 0, None, None, None, rows, start, None, None)], columns=NODE_COLUMNS)]
    for number, t in enumerate(trees, 1):
        inner = t["left"] != np.arange(len(t["left"]))
        where = [None if not i else float(cuts[f][c]) for i, f, c in zip(inner, t["feature"], t["code"])]
        some = lambda v: pd.Series(v).where(pd.Series(inner))
        parts.append(pd.DataFrame({
            "tree": number, "node": np.arange(len(inner)), "feature": some(t["feature"]), "threshold": where, "gain": some(t["gain"]),
            "rows": t["rows"], "prediction": t["value"], "left": some(t["left"]), "right": some(t["right"])}))
    whole = pd.concat([p.astype(object) for p in parts], ignore_index=True)
    ints = {c: "Int32" for c in ("tree", "node", "feature", "left", "right")}
    return whole.astype({**ints, "rows": "int64", "threshold": "float64", "gain": "float64", "prediction": "float64"})


def fit_trees(rows: DataFrame, keys: list[str], order: list[str], cuts: dict, by: str, settings: Callable, fits: int) -> DataFrame:
    """Nodes of the models of each group of ``keys``: the keys, ``part`` and the columns of NODE.

    ``rows`` has codes, y and is_val; ``settings`` gives (part, kind, tree settings, label of y) of each model for the key values,
    ``by`` is the key of the cuts. Groups have at most TASK_CELLS codes; each is one task, ``fits`` of them. Its rows come in
    batches and are held once, feature by feature.
    """
    wanted = [*order, "codes", "y", "is_val"]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in keys}

    def one(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = {k: v.as_py() for k, v in zip(keys, key)}
        own = cuts.get(named[by], [])
        parts, rest = [], []
        for batch in batches:
            column = batch.column("codes")
            joined = b"".join(column.to_pylist())
            parts.append(np.frombuffer(joined, np.uint8).reshape(len(column), -1))
            rest.append(batch.select([*order, "y", "is_val"]).to_pandas())
        rest = pd.concat(rest, ignore_index=True)
        codes, n = np.empty((parts[0].shape[1], len(rest)), np.uint8), 0
        for i, part in enumerate(parts):
            codes[:, n:n + len(part)] = part.T
            n, parts[i] = n + len(part), None
        rest = rest.sort_values(order, kind="stable")
        for column in codes:
            column[:] = column[rest.index]
        y, is_val = rest["y"].to_numpy(np.float64), rest["is_val"].to_numpy(bool)
        for part, kind, s, label in settings(named):
            nodes = fit(codes.T, label(y), is_val, kind, s, own)
            nodes.insert(0, "part", part)
            for k in reversed(keys):
                nodes.insert(0, k, named[k])
            yield from pa.Table.from_pandas(nodes, schema=out, preserve_index=False).to_batches()

    head = ", ".join(f"{k} {v}" for k, v in kinds.items())
    schema = StructType.fromDDL(f"{head}, part string, {NODE}")
    out = to_arrow_schema(schema)
    spread = rows.select(*dict.fromkeys([*keys, *wanted])).repartition(4 * fits, *keys)
    return spread.groupBy(*keys).applyInArrow(one, schema)


class Forest:
    """Nodes of one model as arrays; ``raw`` sums the leaves that rows fall into."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"])
        tree = nodes["tree"].to_numpy(np.int64)
        self.roots = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
        base = self.roots[np.cumsum(np.r_[True, tree[1:] != tree[:-1]]) - 1]
        me, leaf = np.arange(len(nodes)), nodes["feature"].isna().to_numpy()
        child = lambda c: np.where(leaf, me, nodes[c].fillna(0).to_numpy(np.int64) + base)
        self.left, self.right = child("left"), child("right")
        self.feature = nodes["feature"].fillna(0).to_numpy(np.int64)
        self.threshold = nodes["threshold"].fillna(np.inf).to_numpy(np.float64)
        self.value = nodes["prediction"].to_numpy(np.float64)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(x)), max(1, CELLS // len(self.roots))
        for i in range(0, len(x), step):
            part = x[i:i + step]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            while True:
                low = part[rows, self.feature[node]] <= self.threshold[node]
                further = np.where(low, self.left[node], self.right[node])
                if (further == node).all():
                    break
                node = further
            out[i:i + step] = self.value[node].sum(axis=1)
        return out

    def share(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.raw(x)))


def forests(nodes: DataFrame, keys: list[str]) -> dict:
    """The models of a node table by key; their size is bounded by rounds and depth, whatever the rows were.

    Tasks make them, so the driver gets arrays and not rows of nodes.
    """
    def packed(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, pickle.dumps(Forest(part)))], columns=[*keys, "forest"])

    head = ", ".join(f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys)
    table = nodes.select(*keys, *NODE_COLUMNS).groupBy(*keys).applyInPandas(packed, f"{head}, forest binary").collect()
    return {r[:-1] if len(keys) > 1 else r[0]: pickle.loads(r["forest"]) for r in table}
