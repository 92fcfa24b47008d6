"""Boosting against a booster by hand, which sees all rows at once and searches each leaf feature by feature."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.operators import boosting, extra_trees
from packetloom.operators.boosting import Settings
from packetloom.plans import evaluation

FEATURES = list("abcd")


def by_hand(x, y, w, edges, n_classes, s, held=None):
    """Probabilities after each round."""
    bins = np.array([[sum(e < v for e in edges[f]) for f, v in enumerate(row)] for row in x])
    kept = np.ones(len(x), bool) if held is None else ~held
    margins = np.zeros((len(x), n_classes))
    if s.prior:
        share = np.array([w[y == k].sum() for k in range(n_classes)]) / w.sum()
        margins += np.log(share) - np.log(share).mean()
    rounds, leaf_counts, losses = [], [], []
    for _ in range(s.rounds):
        p = np.exp(margins - margins.max(axis=1)[:, None])
        p /= p.sum(axis=1)[:, None]
        if held is not None:
            losses.append(-(w * np.log(p[np.arange(len(y)), y]))[held].sum() / w[held].sum())
            if len(losses) > s.patience and min(losses[-s.patience :]) >= losses[-s.patience - 1] - s.tolerance:
                break
        for k in range(n_classes):
            g, h = w * (p[:, k] - (y == k)), s.curvature * w * p[:, k] * (1 - p[:, k])
            leaves = [(np.ones(len(x), bool), 0)]

            def split(rows, depth, g=g, h=h):
                own, found = rows & kept, (0.0,)
                if s.depth is not None and depth >= s.depth:
                    return found
                for f in range(x.shape[1]):
                    for b in range(len(edges[f])):
                        left = own & (bins[:, f] <= b)
                        right = own & ~left
                        if min(left.sum(), right.sum()) < max(1, s.leaf) or min(h[left].sum(), h[right].sum()) < s.weight:
                            continue
                        worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + s.penalty)
                        gain = round(0.5 * (worth(left) + worth(right) - worth(own)), 9)
                        if gain > found[0]:
                            found = (gain, f, b)
                return found

            best = [split(*leaves[0])]
            while len(leaves) < (s.leaves or 1 << s.depth) and max(best)[0] > 0:
                i = max(range(len(best)), key=lambda j: best[j][0])
                (rows, depth), (_, f, b) = leaves.pop(i), best.pop(i)
                for part in (rows & (bins[:, f] <= b), rows & (bins[:, f] > b)):
                    leaves.append((part, depth + 1))
                    best.append(split(part, depth + 1))
            for rows, _ in leaves:
                margins[rows, k] += -s.step * g[rows & kept].sum() / (h[rows & kept].sum() + s.penalty)
            leaf_counts.append(len(leaves))
        p = np.exp(margins - margins.max(axis=1)[:, None])
        rounds.append(p / p.sum(axis=1)[:, None])
    return rounds, leaf_counts, losses


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int) + (x[:, 3] > 0.8)
    w = rng.choice([0.5, 1.0, 3.0], 400)
    data = pd.DataFrame(x, columns=FEATURES).assign(y=y, w=w, key=np.arange(400))
    return data, spark.createDataFrame(data).repartition(3, "key").cache()


def probabilities(model, df):
    return np.array([r["probabilities"] for r in model.transform(df).orderBy("key").collect()])


@pytest.mark.parametrize("settings", [Settings(rounds=2, depth=3, bins=16), Settings(rounds=2, depth=None, leaves=6, leaf=15, weight=1e-3, penalty=0.0, curvature=1.0, prior=True, bins=16)])
def test_same_as_by_hand(rows, settings):
    data, df = rows
    model = boosting.fit(df, FEATURES, "y", 3, settings, weight="w", key="key")
    want, leaves, _ = by_hand(data[FEATURES].to_numpy(), data["y"].to_numpy(), data["w"].to_numpy(), model.edges, 3, settings)
    assert np.allclose(probabilities(model, df), want[-1], atol=1e-9)
    assert [sum(f < 0 for f in t.feature) for trees in model.rounds for t in trees] == leaves and max(leaves) <= (settings.leaves or 8)


def test_ends_when_held_out_loss_stops_falling(rows):
    data, df = rows
    s = Settings(rounds=30, step=0.7, depth=None, leaves=12, leaf=2, weight=1e-3, penalty=1.0, curvature=1.0, prior=True, bins=8, patience=2, held_out=0.3)
    model = boosting.fit(df, FEATURES, "y", 3, s, weight="w", key="key")
    held = boosting._uniform(data["key"].to_numpy(), s.seed) < s.held_out
    _, _, losses = by_hand(data[FEATURES].to_numpy(), data["y"].to_numpy(), data["w"].to_numpy(), model.edges, 3, s, held)
    assert len(model.rounds) < 30 and len(model.losses) == len(losses) and np.allclose(model.losses, losses)


def test_samples_of_rows_and_features(rows):
    data, df = rows
    s = Settings(rounds=2, depth=2, bins=16, share=0.5, features=0.5)
    a, b = (boosting.fit(df.repartition(n), FEATURES, "y", 3, s, key="key", edges=None) for n in (2, 5))
    assert [t.feature for r in a.rounds for t in r] == [t.feature for r in b.rounds for t in r]  # whatever the partitions
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for r in a.rounds for t in r)
    used = boosting._uniform(data["key"].to_numpy(), s.seed + 1) < 0.5
    assert 140 < used.sum() < 260


def test_equal_rows_are_one_row(rows, monkeypatch):
    _, df = rows
    sizes, written = [], boosting.written
    monkeypatch.setattr(boosting, "written", lambda df, name: sizes.append(written(df, name).count()) or written(df, name))
    many = df.crossJoin(df.sparkSession.range(5).select(F.col("id").alias("copy"))).withColumn("key", F.xxhash64("key", "copy"))
    s, edges = Settings(rounds=2, depth=2, bins=16, leaf=10), boosting.bin_edges(df, FEATURES, 16)
    a, b = (boosting.fit(x, FEATURES, "y", 3, t, weight="w", key="key", edges=edges) for x, t in ((df, replace(s, leaf=2, weight=0.2, penalty=0.2)), (many, s)))
    assert sizes[0] == sizes[1] <= df.count()  # copies are counted, with rows of a leaf and weights
    assert [(t.feature, t.bin) for r in a.rounds for t in r] == [(t.feature, t.bin) for r in b.rounds for t in r]
    assert np.allclose(probabilities(a, df), probabilities(b, df))
    sizes.clear()
    boosting.fit(many, FEATURES, "y", 3, Settings(rounds=1, depth=1, share=0.5), key="key")
    assert sizes == [many.count()]  # samples tell rows apart


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 7.0, 0), (2, float("nan"), 7.0, 0), (3, 1.0, 7.0, 1), (4, 2.0, 7.0, 1)], "key long, a double, b double, y int")
    model = boosting.fit(df, ["a", "b"], "y", 2, Settings(rounds=3, depth=2, weight=0.0), key="key")
    assert [r["prediction"] for r in model.transform(df).orderBy("key").collect()] == [0, 0, 1, 1] and model.edges[1] == []
    assert boosting.Boosted.from_json(model.to_json()) == model
    assert boosting.fit(df.limit(0), ["a"], "y", 2, Settings(rounds=3)).rounds == []
    with pytest.raises(ValueError):
        boosting.fit(df, ["a"], "y", 2, Settings(bins=500))


def test_query(spark, sf_dir):
    rows = evaluation.boosted_rows(spark, sf_dir).sample(0.1, seed=1).cache()  # by hand takes long
    model = boosting.fit(rows, evaluation.BOOSTED_ON, "true_id", 3, evaluation.BOOSTING, key="key")
    data = rows.orderBy("key").toPandas()
    want, _, _ = by_hand(data[list(evaluation.BOOSTED_ON)].to_numpy(), data["true_id"].to_numpy(), np.ones(len(data)), model.edges, 3, evaluation.BOOSTING)
    assert np.allclose(probabilities(model, rows), want[-1], atol=1e-9)
    found = evaluation.boosted_predictions(spark, sf_dir)
    assert found.count() == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() and found.where(F.col("confidence").isNull() | ~F.col("predicted_id").isin(0, 1, 2)).count() == 0


# --- extra trees ---------------------------------------------------------------------------------------
def forest_by_hand(x, y, w, edges, n_classes, some, s):
    """Class shares of each row's leaf in each tree, each leaf split on its own."""
    bins = np.array([[sum(e < v for e in edges[f]) for f, v in enumerate(row)] for row in x])
    every = []
    for tree in range(s.trees):
        out, numbers, level = np.zeros((len(x), n_classes)), 1, [(0, np.arange(len(x)))]
        for depth in range(s.depth + 1):
            below = []
            for node, rows in level:
                out[rows] = np.bincount(y[rows], w[rows], n_classes) / w[rows].sum()
                features, us = extra_trees.drawn(s.seed, tree, node, x.shape[1], some)
                best = None
                for f, u in zip(features, us, strict=True):
                    own = bins[rows, f]
                    if own.min() == own.max() or len(set(y[rows])) == 1:
                        continue
                    at = edges[f][own.min()] + u * (edges[f][own.max() - 1] - edges[f][own.min()])
                    cut = max(b for b in range(own.min(), own.max()) if b == own.min() or edges[f][b] <= at)
                    sides = [rows[own <= cut], rows[own > cut]]
                    if min(map(len, sides)) < s.leaf:
                        continue
                    impurity = lambda r: w[r].sum() - (np.bincount(y[r], w[r]) ** 2).sum() / w[r].sum()
                    gain = round(impurity(rows) - sum(map(impurity, sides)), 9)
                    if gain > (best[0] if best else 0):
                        best = (gain, sides)
                if best and depth < s.depth:
                    below += [(numbers, best[1][0]), (numbers + 1, best[1][1])]
                    numbers += 2
            level = below
        every.append(out)
    return np.mean(every, axis=0)


def test_extra_trees_same_as_by_hand(rows):
    data, df = rows
    s = extra_trees.Settings(trees=5, depth=4, leaf=3, bins=16, group=3)
    model = extra_trees.fit(df, FEATURES, "y", 3, s, weight="w")
    want = forest_by_hand(data[FEATURES].to_numpy(), data["y"].to_numpy(), data["w"].to_numpy(), model.edges, 3, 2, s)
    assert np.allclose(probabilities(model, df), want) and len({tuple(t.bin) for t in model.trees}) == 5
    assert extra_trees.Forest.from_json(model.to_json()) == model
    empty = extra_trees.fit(df.limit(0), FEATURES, "y", 3, s)
    assert np.allclose(probabilities(empty, df), 1 / 3)
