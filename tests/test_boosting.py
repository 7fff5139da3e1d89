import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import boosting, hurdle

S = hurdle.TreeSettings(rounds=30, patience=4, depth=3, step=0.3, min_rows=5, features="all", subsample=1.0, bins=16)


def data(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 4))
    x[rng.random((n, 4)) < 0.05] = np.nan
    y = np.where(np.nan_to_num(x[:, 0]) > 0.5, 1 + 2 * np.nan_to_num(x[:, 1]), 0) + rng.normal(0, 0.3, n)
    return x, y, np.arange(n) % 3 == 0


def code(x, bins=16):
    cuts = [np.unique(np.quantile(c[~np.isnan(c)], np.arange(1, bins) / bins, method="lower")) for c in x.T]
    return np.stack([np.searchsorted(c, v) for c, v in zip(cuts, x.T)], axis=1).astype(np.uint8), cuts


@pytest.mark.parametrize("kind", ["absolute", "logistic"])
def test_prefix_of_best_round_and_stop(kind):
    x, y, val = data()
    y = y if kind == "absolute" else (y > 0.8).astype(float)
    codes, cuts = code(x)
    nodes = boosting.fit(codes, y, val, kind, S, cuts)
    best = int(nodes["tree"].max())
    assert 1 < best < S.rounds
    exact = boosting.fit(codes, y, np.zeros(len(y), bool) | False, kind, dataclasses.replace(S, rounds=1), cuts)
    assert exact["tree"].max() == 1
    again = boosting.fit(codes[~val], y[~val], val[~val], kind, dataclasses.replace(S, rounds=best), cuts)
    pd.testing.assert_frame_equal(nodes, again)  # no validation rows: exactly that many rounds
    error = lambda k: held_error(nodes[nodes["tree"] <= k], x[val], y[val], kind)
    assert error(best) == min(error(k) for k in range(best + 1)) < 0.8 * error(0)


def held_error(nodes, x, y, kind):
    raw = boosting.Forest(nodes).raw(x)
    return np.abs(y - raw).mean() if kind == "absolute" else np.logaddexp(0, np.where(y > 0, -raw, raw)).mean()


def test_numbers_and_codes_fall_into_the_same_leaves():
    x, y, val = data()
    codes, cuts = code(x)
    nodes = boosting.fit(codes, y, val, "absolute", S, cuts)
    on_codes = nodes.copy()
    split = nodes["feature"].notna()
    on_codes.loc[split, "threshold"] = [float(np.searchsorted(cuts[f], t)) for f, t in zip(nodes.loc[split, "feature"], nodes.loc[split, "threshold"])]
    assert (boosting.Forest(nodes).raw(x) == boosting.Forest(on_codes).raw(codes.astype(float))).all()


def test_first_split_by_brute_force():
    x, y, val = data(200)
    codes, cuts = code(x)
    g = np.sign(y - np.median(y))
    tree = boosting.grow(codes, g, None, 16, dataclasses.replace(S, depth=1), np.arange(4))
    gains = {}
    for f in range(4):
        for c in range(len(cuts[f])):
            low = codes[:, f] <= c
            if min(low.sum(), (~low).sum()) >= S.min_rows:
                gains[f, c] = g[low].sum() ** 2 / low.sum() + g[~low].sum() ** 2 / (~low).sum() - g.sum() ** 2 / len(g)
    assert gains[tree["feature"][0], tree["code"][0]] == pytest.approx(max(gains.values()))
    assert tree["gain"][0] == pytest.approx(max(gains.values())) and tree["rows"][1] + tree["rows"][2] == 200


def test_blocks_give_the_same_trees(monkeypatch):
    x, y, val = data()
    codes, cuts = code(x)
    whole = boosting.fit(codes, y, val, "absolute", S, cuts)
    raw = boosting.Forest(whole).raw(x)
    monkeypatch.setattr(boosting, "CELLS", 64)
    pd.testing.assert_frame_equal(whole, boosting.fit(codes, y, val, "absolute", S, cuts))
    assert (boosting.Forest(whole).raw(x) == raw).all()


def test_defined_for_awkward_labels():
    codes, cuts = np.zeros((20, 2), np.uint8), [np.array([]), np.array([])]
    none, val = np.zeros(20, bool), np.arange(20) % 2 == 0
    for label, share in ((0.0, 0.0), (1.0, 1.0)):
        model = boosting.Forest(boosting.fit(codes, np.full(20, label), val, "logistic", S, cuts))
        assert (model.share(np.zeros((3, 2))) == share).all()
    flat = boosting.fit(codes, np.full(20, 2.5), val, "absolute", S, cuts)
    assert (boosting.Forest(flat).raw(np.full((3, 2), np.nan)) == 2.5).all()
    empty = boosting.fit(codes[:0], np.zeros(0), none[:0], "absolute", S, cuts)
    assert len(empty) == 1 and boosting.Forest(empty).raw(np.zeros((2, 2))).tolist() == [0, 0]


def test_cuts_and_codes_per_group(spark):
    rows = [(g, i, [float(i * (g + 1)), None if i % 7 == 0 else 1.0]) for g in (0, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "fold int, region_id long, x array<float>")
    cuts = boosting.feature_cuts(df, "fold", ["region_id"], 8)
    assert sorted(cuts) == [0, 1] and len(cuts[0][0]) == 7 and (2 * cuts[0][0] == cuts[1][0]).all()
    assert len(cuts[0][1]) == 0  # one value: nothing to cut
    for r in boosting.coded(df, "fold", cuts).join(df, ["fold", "region_id"]).collect():
        assert list(r["codes"]) == [int((cuts[r["fold"]][0] < r["x"][0]).sum()), 0]


def test_bounded_hurdle_is_repeatable_and_stored(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for fold in (0, 1):
        for i in range(300):
            a, b = rng.random(2)
            rows.append((fold, i, "val" if i % 5 == 0 else "train", i, [float(a), float(b)], [float(a > 0.5) * float(1 + 3 * b), 0.0]))
    samples = spark.createDataFrame(rows, "fold int, region_id long, split string, start long, x array<float>, y array<float>")
    test = samples.filter("region_id < 10").select("fold", "region_id", "x")
    settings = hurdle.HurdleSettings(S, S, most_rows=200)
    folder = str(tmp_path / "models")
    held, ahead = hurdle.train_hurdle(samples, test, settings, horizon=2, model_folder=folder)
    other, _ = hurdle.train_hurdle(samples.repartition(7), test, settings, horizon=2)
    assert sorted(held.collect()) == sorted(other.collect()) and held.count() == 2 * 2 * 60
    mae = held.filter("horizon = 1").agg(F.avg(F.abs(F.col("pred_a") - F.col("y_true"))), F.avg("y_true")).first()
    assert mae[0] < 0.5 * mae[1]
    assert ahead.filter("horizon = 2 and prob_b <> 0").count() == 0 and ahead.count() == 2 * 2 * 10
    nodes = hurdle.load_nodes(spark, folder)
    assert sorted(hurdle.predict_nodes(nodes, test, 2).collect()) == sorted(ahead.collect())
    checks = hurdle.tree_checks(hurdle.named_nodes(nodes)).collect()
    assert len(checks) == 8 and all(c.broken == 0 and c.nodes == 2 * c.leaves - c.trees for c in checks)
    start = nodes.filter("tree = 0 and part = 'severity'").agg(F.min("rows"), F.max("rows")).first()
    assert tuple(start) == (200, 200)  # learnt from the drawn rows only


def test_start_is_kept_where_no_tree_is_better():
    x, _, val = data()
    codes, cuts = code(x)
    y = np.where(val, 0.0, np.arange(len(x)) % 2.0)  # training rows mislead
    y[np.flatnonzero(~val)[:3]] = 0.0
    nodes = boosting.fit(codes, y, val, "absolute", S, cuts)
    assert held_error(nodes, x[val], y[val], "absolute") <= np.abs(y[val] - np.median(y[~val])).mean()
    noise = (np.random.default_rng(5).random(len(x)) < 0.5).astype(float)
    nodes = boosting.fit(codes, noise, val, "logistic", S, cuts)
    assert held_error(nodes, x[val], noise[val], "logistic") <= held_error(nodes[nodes["tree"] == 0], x[val], noise[val], "logistic")
