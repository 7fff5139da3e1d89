"""Two-part model: occurrence classifier and severity regressor, per fold and horizon."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import ENCODED, HORIZON, SEED
from ..session import shared_folder, stage
from . import boosting
from .ranks import auc
from .splits import KEY


#: Rows that a task of a fit holds; smaller frames are put together, as each task sends whole histograms.
ROWS_PER_TASK = 20_000


@dataclass
class TreeSettings:
    """Boosting parameters. The best number of rounds is chosen on the rows marked ``is_val``: the last one of least
    error before ``patience`` rounds without a better one. ``first`` rounds are fitted, then twice as many and so on, until
    the patience has passed or there are ``rounds``."""

    rounds: int = 200
    patience: int = 20
    first: int = 25
    depth: int = 7
    step: float = 0.05
    min_rows: int = 150
    features: str = "0.5"
    subsample: float = 0.8
    bins: int = 32
    seed: int = SEED


@dataclass
class HurdleSettings:
    """None for ``most_rows``, the default, learns from all labelled windows of a fold and chooses its rounds on all of its
    validation windows; a number bounds both, drawn by a hash of their keys. Fits run side by side, each in a task (``boosting``), or
    by all tasks together if a fold has more than a task holds. Predictions are made for all rows either way."""

    severity: TreeSettings = field(default_factory=TreeSettings)
    occurrence: TreeSettings = field(default_factory=lambda: TreeSettings(step=0.02, min_rows=500))
    most_rows: int | None = None


def vector_frame(samples: DataFrame) -> DataFrame:
    """``features`` from the flat window and the two encodings.

    An encoding is the same in all weeks of a window, so it enters once: repeated columns give a
    tree no further split.
    """
    return samples.withColumn("features", array_to_vector(flat_window(samples))).drop("x")


def flat_window(samples: DataFrame) -> Column:
    pair = F.array(*[F.col(c).cast("float") for c in ENCODED])
    return F.concat(F.col("x"), pair) if set(ENCODED) <= set(samples.columns) else F.col("x")


def _params(s: TreeSettings, rounds: int) -> dict:
    return dict(
        featuresCol="features", maxIter=rounds, maxDepth=s.depth, stepSize=s.step,
        minInstancesPerNode=s.min_rows, featureSubsetStrategy=s.features, subsamplingRate=s.subsample,
        maxBins=s.bins, seed=s.seed, checkpointInterval=25,
    )


def best_round(errors: list[float], patience: int) -> int:
    """Rounds (from 1) with the least error, looking no further than ``patience`` rounds after it."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def first_trees(model, k: int):
    """The model of the first ``k`` trees of a boosted model.

    With the same seed and rows a fit of k rounds gives the same trees, so there is nothing to fit again.
    """
    if k >= model.getNumTrees:
        return model
    jvm, java = _jvm(), model._java_obj
    all_trees, all_weights = java.trees(), java.treeWeights()
    new_array = jvm.java.lang.reflect.Array.newInstance
    trees, weights = new_array(all_trees[0].getClass(), k), new_array(jvm.java.lang.Double.TYPE, k)
    for i in range(k):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    kind = jvm.org.apache.spark.ml
    kind = kind.regression.GBTRegressionModel if isinstance(model, GBTRegressionModel) else kind.classification.GBTClassificationModel
    short = type(model)(kind(f"{java.uid()}_{k}", trees, weights))
    return model._copyValues(short)


def _jvm():
    from pyspark import SparkContext
    return SparkContext._active_spark_context._jvm


def _put_together(frame: DataFrame, rows: int) -> DataFrame:
    return frame.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def _boosted(make: Callable, frame: DataFrame, settings: TreeSettings, errors: Callable):
    """Fit on the train rows and keep the number of rounds that serves the validation rows best.

    Rounds double until ``patience`` rounds have passed since the best, so the last fit has less than twice the
    rounds that had to be seen, and all together less than twice the last.
    """
    train, val = frame.filter(~F.col("is_val")), frame.filter("is_val")
    if val.limit(1).count() == 0:
        return make(settings.rounds).fit(train)
    rounds = min(settings.first, settings.rounds)
    while True:
        model = make(rounds).fit(train)
        best = best_round(errors(model, val), settings.patience)
        if best + settings.patience <= rounds or rounds >= settings.rounds:
            return first_trees(model, best)
        rounds = min(2 * rounds, settings.rounds)


def fit_severity(frame: DataFrame, settings: TreeSettings) -> GBTRegressionModel:
    def make(rounds: int):
        return GBTRegressor(labelCol="y", lossType="absolute", predictionCol="pred_a", **_params(settings, rounds))
    return _boosted(make, frame, settings, lambda model, val: model.evaluateEachIteration(val, "absolute"))


def _classifier(settings: TreeSettings, rounds: int, label: str) -> GBTClassifier:
    out = GBTClassifier(labelCol=label, predictionCol="_class", **_params(settings, rounds))
    return out.setRawPredictionCol("_raw").setProbabilityCol("_prob")


def fit_occurrence(frame: DataFrame, settings: TreeSettings, label: str = "occurs") -> GBTClassificationModel:
    return _boosted(lambda rounds: _classifier(settings, rounds, label), frame, settings,
                    lambda model, val: model.evaluateEachIteration(val))


def model_path(folder: str, part: str, fold: int, horizon: int) -> str:
    return f"{folder}/{part}_fold{fold}_h{horizon}"


def _fold_rows(samples: DataFrame, fold: int, most: int | None) -> DataFrame:
    """Vectors of the rows of a fold, its training rows bounded."""
    from .explore import seeded_sample
    mine = samples.filter(F.col("fold") == fold)
    train, val = mine.filter(F.col("split") == "train"), mine.filter(F.col("split") == "val")
    if most is not None:
        train = seeded_sample(train, most, [KEY, "start"])
    both = train.unionByName(val)
    vectors = vector_frame(both).select(KEY, "features", "y", (F.col("split") == "val").alias("is_val"))
    return _put_together(vectors, both.count())


class _Held:
    """Frames of folds, cached when the first of their fits begins and let go after the last."""

    def __init__(self, make: Callable[[int], DataFrame], fits: int):
        self.make, self.fits, self.lock = make, fits, Lock()
        self.frames: dict[int, list] = {}

    def take(self, fold: int) -> DataFrame:
        with self.lock:
            if fold not in self.frames:
                self.frames[fold] = [self.make(fold).persist(), self.fits]
            return self.frames[fold][0]

    def give_back(self, fold: int) -> None:
        with self.lock:
            self.frames[fold][1] -= 1
            if not self.frames[fold][1]:
                self.frames.pop(fold)[0].unpersist()


def train_hurdle(
    samples: DataFrame, test: DataFrame, settings: HurdleSettings | None = None,
    horizon: int = HORIZON, model_folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Fit every fold and horizon; return long out-of-fold and test predictions.

    ``samples`` has fold, split, start, x, y and encodings; ``test`` has fold, x and encodings. Windows are coded once per fold
    and stored so; they are worked out once for the cuts and once for the codes.
    """
    settings = settings or HurdleSettings()
    spark = samples.sparkSession
    folds = [r[0] for r in samples.select("fold").distinct().orderBy("fold").collect()]
    if settings.most_rows is None:
        labelled = _labelled(samples)
    else:
        with ThreadPoolExecutor(len(folds)) as pool:
            labelled = stage(_union(list(pool.map(lambda fold: _drawn(samples, fold, settings.most_rows), folds))), "drawn-windows")
    bins = max(settings.severity.bins, settings.occurrence.bins)
    order = [KEY, "start"]
    cuts = boosting.feature_cuts(labelled.filter(~F.col("is_val")), "fold", order, bins)
    codes = stage(boosting.coded(labelled, "fold", cuts), "coded-windows")
    model_folder = model_folder or f"{shared_folder(spark)}/fieldloom/models-{uuid.uuid4().hex}"
    if _fits_task(codes, "fold"):
        def of(key: dict):
            return [("severity", "absolute", settings.severity, np.asarray),
                    ("occurrence", "logistic", settings.occurrence, lambda y: (y > 0).astype(np.float64))]

        horizons = F.array(*[F.struct(F.lit(h + 1).alias("horizon"), F.col("y")[h].cast("double").alias("_y")) for h in range(horizon)])
        tasks = codes.select("fold", *order, "is_val", "codes", F.inline(horizons)).withColumnRenamed("_y", "y")
        nodes = boosting.fit_trees(tasks, ["fold", "horizon"], order, cuts, "fold", of, len(folds) * horizon)
        nodes.write.mode("overwrite").partitionBy(*MODEL).parquet(model_folder)
    else:
        def frame(fold: int) -> DataFrame:
            return code_vectors(codes.filter(F.col("fold") == fold), ["is_val", "y"])

        held = _Held(frame, 2 * horizon)

        def one(task: tuple[int, int, str]) -> None:
            fold, h, part = task
            y = F.col("y")[h].cast("double")
            kind, label, own = ("absolute", y, settings.severity) if part == "severity" else (
                "logistic", (y > 0).cast("double"), settings.occurrence)
            try:
                rows = held.take(fold).select("features", "is_val", label.alias("y"))
                fit_spread(rows, kind, own, cuts[fold]).write.mode("overwrite").parquet(
                    f"{model_folder}/fold={fold}/part={part}/horizon={h + 1}")
            finally:
                held.give_back(fold)

        with ThreadPoolExecutor(SPREAD_FITS) as pool:
            list(pool.map(one, [(fold, h, part) for fold in folds for part in ("severity", "occurrence") for h in range(horizon)]))
    nodes = load_nodes(spark, model_folder)
    held_out = predict_nodes(nodes, samples.filter(F.col("split") == "val"), horizon)
    return stage(held_out, "out-of-fold"), stage(predict_nodes(nodes, test, horizon), "predictions")


def _fits_task(codes: DataFrame, by: str) -> bool:
    """Whether a task can hold the codes of each group."""
    wide = codes.select(F.octet_length("codes")).first()
    most = codes.groupBy(by).count().agg(F.max("count")).first()[0]
    return wide is None or most * wide[0] <= boosting.TASK_CELLS


#: Fits that all tasks work on together run so many at a time.
SPREAD_FITS = 4


def code_vectors(codes: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the codes as vectors ``features``."""
    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
            wide = len(flat) // len(column) if len(column) else 0
            lists = pa.ListArray.from_arrays(np.arange(len(column) + 1, dtype=np.int32) * wide, flat.astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], [*keep, "x"])

    head = ", ".join(f"{c} {codes.schema[c].dataType.simpleString()}" for c in keep)
    return codes.select(*keep, "codes").mapInArrow(numbers, f"{head}, x array<double>").select(
        *keep, array_to_vector("x").alias("features"))


def fit_spread(rows: DataFrame, kind: str, settings: TreeSettings, cuts: list) -> DataFrame:
    """Nodes of one model, as ``boosting.fit`` gives them, fitted by all tasks together on (features, is_val, y) with codes for features.

    Spark ML's boosting is fitted on what the start leaves; it has codes of few values, so its thresholds are the cuts.
    The start alone is the model where no tree does better on the validation rows, and with labels of one class.
    """
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    absolute = kind == "absolute"
    known = rows.filter(~F.col("is_val")).agg(
        F.percentile_approx("y", 0.5, 1_000_000).alias("middle"), F.avg("y").alias("share"), F.count(F.lit(1)).alias("n")).first()
    start = 0.0 if known["n"] == 0 and absolute else float(known["middle"]) if absolute else _log_odds(0.5 if known["n"] == 0 else known["share"])

    def stump(value: float) -> DataFrame:
        return spark.createDataFrame([(0, 0, None, None, None, known["n"], value, None, None)], boosting.NODE)

    if not np.isfinite(start) or known["n"] == 0:
        return stump(start)
    val = rows.filter("is_val")
    if absolute:
        rows, val = (df.withColumn("y", F.col("y") - start) for df in (rows, val))
        model = fit_severity(rows, settings)
        error, times = F.abs("y"), 1.0
    else:
        # Spark's margins are half the log odds, and its loss is twice the log loss.
        model = fit_occurrence(rows, settings, "y")
        error, times = 2 * F.when(F.col("y") > 0, F.lit(float(np.logaddexp(0, -start)))).otherwise(float(np.logaddexp(0, start))), 2.0
    least = val.agg(F.avg(error)).first()[0]
    if least is not None:
        val = val.withColumn("label", F.col("y"))  # what a model cut to its first trees looks for
        errors = model.evaluateEachIteration(val, "absolute") if absolute else model.evaluateEachIteration(val)
        if not errors[-1] < least:
            return stump(start)
    path = f"{shared_folder(spark)}/fieldloom/spread-{uuid.uuid4().hex}"
    model.write().save(path)
    weights, columns = model.treeWeights, boosting.NODE_COLUMNS

    def numbered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            inner = part["feature"].notna()
            part["threshold"] = [float(cuts[int(f)][int(t)]) if i else None for i, f, t in zip(inner, part["feature"], part["threshold"])]
            part["prediction"] = [times * weights[t] * v for t, v in zip(part["tree"], part["prediction"])]
            part["tree"] += 1
            ints = {c: "Int32" for c in ("tree", "node", "feature", "left", "right")}
            yield part[columns].astype({**ints, "rows": "int64", "threshold": "float64"})

    trees = tree_nodes(spark, [path]).drop("model").mapInPandas(numbered, boosting.NODE)
    return stump(start if absolute else 0.0).unionByName(trees)


def _log_odds(share: float) -> float:
    with np.errstate(divide="ignore"):
        return float(np.log(share) - np.log1p(-share))


def _labelled(samples: DataFrame) -> DataFrame:
    """Training and validation rows of all folds: fold, key, start, is_val, y and the flat window."""
    return samples.select("fold", KEY, "start", (F.col("split") == "val").alias("is_val"), "y", flat_window(samples).alias("x"))


def _drawn(samples: DataFrame, fold: int, most: int) -> DataFrame:
    """At most ``most`` training and as many validation rows of a fold: fold, key, start, is_val, y and the flat window."""
    from .explore import seeded_sample
    mine = samples.filter(F.col("fold") == fold)
    parts = [seeded_sample(mine.filter(F.col("split") == split), most, [KEY, "start"]) for split in ("train", "val")]
    return _labelled(parts[0].unionByName(parts[1]))


MODEL = ["fold", "part", "horizon"]


def load_nodes(spark, folder: str) -> DataFrame:
    """Stored models, one folder for each fold, part and horizon, as one table of nodes."""
    return spark.read.schema(f"{boosting.NODE}, fold int, part string, horizon int").parquet(folder)


def named_nodes(nodes: DataFrame) -> DataFrame:
    """The same with one column ``model`` in place of its parts, as ``tree_nodes`` gives them."""
    return nodes.select(F.concat_ws("_", "part", F.concat(F.lit("fold"), "fold"), F.concat(F.lit("h"), "horizon")).alias("model"),
                        *boosting.NODE_COLUMNS)


def predict_nodes(nodes: DataFrame, frame: DataFrame, horizon: int) -> DataFrame:
    """Long predictions of all rows of ``frame`` by the models of their fold, one pass a fold; with y_true where it has ``y``."""
    has_y = "y" in frame.columns
    kind = f"fold int, {KEY} {frame.schema[KEY].dataType.simpleString()}, horizon int, pred_a double, prob_b double"
    rows = frame.select("fold", KEY, flat_window(frame).alias("x"), *(["y"] if has_y else []))
    out = []
    for fold in [r[0] for r in nodes.select("fold").distinct().orderBy("fold").collect()]:
        models = boosting.forests(nodes.filter(F.col("fold") == fold), ["part", "horizon"])
        out.append(rows.filter(F.col("fold") == fold).mapInArrow(
            _scorer(models, horizon, has_y), kind + (", y_true double" if has_y else "")))
    return _union(out)


def _scorer(models: dict, horizon: int, has_y: bool) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = boosting.matrix(batch.column("x")), batch.num_rows
            y = boosting.matrix(batch.column("y")) if has_y else None
            for h in range(horizon):
                a, b = models["severity", h + 1].raw(x), models["occurrence", h + 1].share(x)
                columns = [batch.column(0), batch.column(1), pa.array(np.full(n, h + 1, dtype=np.int32)), pa.array(a), pa.array(b)]
                names = ["fold", KEY, "horizon", "pred_a", "prob_b"]
                if has_y:
                    columns.append(pa.array(y[:, h]) if n else pa.array([], pa.float64()))
                    names.append("y_true")
                yield pa.RecordBatch.from_arrays(columns, names)
    return score


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tree_nodes(spark, paths: list[str]) -> DataFrame:
    """Nodes of stored models: model (the last part of its path), tree, node, feature, threshold, gain, rows, prediction,
    left and right. A leaf has neither feature nor children."""
    stored = spark.read.parquet(*[f"{p}/data" for p in paths])
    n, inner = F.col("nodeData"), F.col("nodeData.leftChild") >= 0
    return stored.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)/data/[^/]+$", 1).alias("model"), F.col("treeID").alias("tree"),
        n["id"].alias("node"), F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"), F.when(inner, n["gain"]).alias("gain"),
        n["rawCount"].alias("rows"), n["prediction"].alias("prediction"),
        F.when(inner, n["leftChild"]).alias("left"), F.when(inner, n["rightChild"]).alias("right"))


def tree_checks(nodes: DataFrame) -> DataFrame:
    """Per model: trees, leaves, the leaf of fewest rows, the deepest level, and nodes that no split or no child fits.

    In a binary tree every inner node has two children of its tree, whose rows add up to its own.
    """
    child = nodes.select("model", "tree", F.col("node").alias("child"), F.col("rows").alias("child_rows"))
    inner = nodes.filter("feature is not null").select(
        "model", "tree", "node", "rows", F.explode(F.array("left", "right")).alias("child"))
    sums = inner.join(child, ["model", "tree", "child"], "left").groupBy("model", "tree", "node", "rows").agg(
        F.count("child_rows").alias("children"), F.sum("child_rows").alias("below"))
    broken = sums.groupBy("model").agg(F.count(F.when((F.col("children") != 2) | (F.col("below") != F.col("rows")), 1)).alias("broken"))
    leaf = F.col("feature").isNull()
    return nodes.groupBy("model").agg(
        F.countDistinct("tree").alias("trees"), F.count(F.when(leaf, 1)).alias("leaves"), F.count(F.lit(1)).alias("nodes"),
        F.min(F.when(leaf, F.col("rows"))).alias("least_rows"),
    ).join(broken, "model", "left").fillna(0, ["broken"])


def split_counts(nodes: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, importance, gain): splits on a feature and their gain, as means over the models.

    Features without a split have zeros.
    """
    models = nodes.agg(F.countDistinct("model").cast("double")).scalar()
    names = nodes.sparkSession.createDataFrame(list(enumerate(cols)), "at int, feature string")
    used = nodes.filter("feature is not null").groupBy(F.col("feature").alias("at")).agg(
        F.count(F.lit(1)).alias("splits"), F.sum("gain").alias("gain"))
    zero = F.lit(0.0)
    return names.join(used, "at", "left").select(
        "feature", (F.coalesce("splits", zero) / models).alias("importance"), (F.coalesce("gain", zero) / models).alias("gain"))


def adversarial(
    train: DataFrame, test: DataFrame, cols: list[str], settings: TreeSettings | None = None,
    folds: int = 3, sample: int | None = None, seed: int = SEED, model_folder: str | None = None,
    most_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Can a classifier tell the cohorts apart? Out-of-fold scores and the nodes of the models.

    Folds are stratified by cohort; each fold's rows choose the rounds of its model, and all others are learnt from. The folds are
    fitted side by side. ``most_rows`` bounds the labelled rows of a fold and cohort that models learn from and choose their rounds on;
    None, the default, takes all. All rows are scored either way, each by the model of its own fold.
    """
    from .explore import hash_order, seeded_sample, stratified_folds
    settings = settings or TreeSettings(rounds=500, depth=4, min_rows=20, features="all", subsample=1.0)
    spark = train.sparkSession
    ids = [KEY, "week_idx"]
    keep = [*ids, *cols]
    a = train.select(*keep).dropna(subset=cols)
    if sample is not None:
        a = seeded_sample(a, sample, ids, seed)
    both = a.withColumn("label", F.lit(0)).unionByName(
        test.select(*keep).dropna(subset=cols).withColumn("label", F.lit(1)))
    # The features are stored once and stay where they are: folds are dealt to numbers of rows, and codes, a byte a feature, joined with these.
    both = stage(both.withColumn("_row", F.monotonically_increasing_id()), "adversarial")
    dealt = stage(stratified_folds(both.select(*ids, "label", "_row"), hash_order(ids, seed), folds).select(
        "_row", "label", *ids, F.col("fold").cast("int").alias("fold")), "adversarial-folds")
    numbers = F.array(*[F.col(c).cast("double") for c in cols]).alias("x")
    rows = both.select(*ids, "_row", F.lit(0).alias("all"), F.col("label").cast("double").alias("y"), numbers)
    learnt, picked = rows, None
    if most_rows is not None:
        groups = [(f, label) for f in range(folds) for label in (0, 1)]
        with ThreadPoolExecutor(len(groups)) as pool:
            picked = _union(list(pool.map(lambda g: seeded_sample(
                dealt.filter((F.col("fold") == g[0]) & (F.col("label") == g[1])), most_rows, ids, seed), groups)))
        picked = stage(picked.select("_row"), "adversarial-picked")
        learnt = rows.join(picked, "_row", "left_semi")
    cuts = boosting.feature_cuts(learnt, "all", ids, settings.bins)
    codes = stage(boosting.coded(rows, "all", cuts).join(dealt.select("_row", "fold"), "_row"), "adversarial-codes")
    learnt = codes if picked is None else codes.join(picked, "_row", "left_semi")
    numbered = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("f")
    is_val = (F.col("fold") == F.col("f")).alias("is_val")
    if _fits_task(learnt, "all"):
        tasks = learnt.select(*ids, "_row", "all", "y", "codes", "fold", numbered).select(*ids, "_row", "all", "y", "codes", is_val, "f")
        nodes = boosting.fit_trees(tasks, ["all", "f"], [*ids, "_row"], cuts, "all", lambda key: [("fold", "logistic", settings, np.asarray)], folds)
        nodes = nodes.select(F.concat("part", "f").alias("model"), *boosting.NODE_COLUMNS)
    else:
        held = code_vectors(learnt, ["fold", "y"]).persist()

        def one(f: int) -> DataFrame:
            frame = held.select("features", (F.col("fold") == f).alias("is_val"), "y")
            return stage(fit_spread(frame, "logistic", settings, cuts[0]).select(F.lit(f"fold{f}").alias("model"), "*"), "adversarial-fold")

        try:
            with ThreadPoolExecutor(folds) as pool:
                nodes = _union(list(pool.map(one, range(folds))))
        finally:
            held.unpersist()
    if model_folder is None:
        nodes = stage(nodes, "adversarial-nodes")
    else:
        nodes.write.mode("overwrite").parquet(model_folder)
        nodes = spark.read.schema(nodes.schema).parquet(model_folder)
    return stage(_own_scores(codes, nodes, cuts[0] if cuts else [], ids), "adversarial-scores"), nodes


def _own_scores(codes: DataFrame, nodes: DataFrame, cuts: list, ids: list[str]) -> DataFrame:
    """ids, fold, label and the score of each row by the model of its fold, from codes."""
    models = boosting.forests(nodes, ["model"])
    for model in models.values():  # a number is at most a cut when its code is at most the number of the cut
        model.threshold = np.array([np.searchsorted(cuts[f], t) if t < np.inf else t for f, t in zip(model.feature, model.threshold)], dtype=np.float64)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 0), np.uint8)
            fold, out = batch.column("fold").to_numpy(), np.empty(n)
            for f in np.unique(fold):
                mine = np.flatnonzero(fold == f)
                out[mine] = models[f"fold{f}"].share(x[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*keep, "score"])

    keep = [*ids, "fold", "label"]
    rows = codes.select(*ids, "fold", F.col("y").alias("label"), "codes")
    schema = ", ".join([f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep] + ["score double"])
    return rows.mapInArrow(score, schema)


def adversarial_summary(scored: DataFrame) -> DataFrame:
    """AUC and what it says about the shift."""
    band = F.when(F.col("auc") < 0.55, "low").when(F.col("auc") < 0.65, "moderate").otherwise("high")
    return auc(scored).withColumn("shift", band)


def top_importances(importance: DataFrame, n: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
