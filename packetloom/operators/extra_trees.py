"""Extremely randomised trees on rows that stay distributed: at each leaf a few features are drawn, for each of them a
threshold between its least and largest value there, and the best of these splits is taken.

All trees of a group grow by a level at a time: tasks count rows by leaf, drawn feature, bin and class, the counts are added up by a
shuffle, and a function of each leaf's counts (bins x classes x drawn features at most) draws the thresholds.  Draws follow from a
seed, the tree, the leaf and the feature, so the same rows give the same forest however they are dealt."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import written
from .boosting import Tree, bin_edges, binned, blobs, lists, matrix, numbers


@dataclass(frozen=True)
class Settings:
    """features: drawn at a leaf (sqrt of all unless given); leaf: rows of a leaf at least; group: trees that grow together."""

    trees: int = 60
    depth: int = 20
    leaf: int = 3
    features: int | None = None
    bins: int = 256
    group: int = 20
    seed: int = 42


@dataclass
class Forest:
    """Trees, and the classes' shares at each of their nodes."""

    features: list[str]
    edges: list[list[float]]
    trees: list[Tree]
    shares: list[list[list[float]]]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.mean([np.array(shares)[tree.leaf_of(x)] for tree, shares in zip(self.trees, self.shares, strict=True)], axis=0)

    def transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """df with probabilities and prediction (the first most likely class)."""
        edges, found = self.edges, self.probabilities

        @F.arrow_udf("array<double>")
        def probabilities(*values: pa.Array) -> pa.Array:
            return lists(found(binned([numbers(v) for v in values], edges)))

        named = df.withColumn("probabilities", probabilities(*[F.col(f"`{c}`").cast("double") for c in columns or self.features]))
        return named.withColumn("prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double"))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Forest:
        found = json.loads(text)
        return cls(found["features"], found["edges"], [Tree(**t) for t in found["trees"]], found["shares"])


def drawn(seed: int, tree: int, node: int, n_features: int, some: int) -> tuple[np.ndarray, np.ndarray]:
    """Features drawn at a leaf, and for each a number from 0 to 1."""
    rng = np.random.default_rng([seed, tree, node])
    return np.sort(rng.choice(n_features, some, replace=False)), rng.random(some)


def threshold(u: float, low: int, high: int, edges: Sequence[float]) -> int:
    """The last bin of the left side, for a value drawn between the edges above the lowest and below the highest bin."""
    at = edges[low] + u * (edges[high - 1] - edges[low])
    return min(max(int(np.searchsorted(edges, at, "right")) - 1, low), high - 1)


def gini(w: np.ndarray) -> float:
    total = w.sum()
    return float(total - (w * w).sum() / total) if total > 0 else 0.0


def split_of(counts: pd.DataFrame, tree: int, node: int, edges: Sequence[Sequence[float]], n_classes: int, some: int, s: Settings) -> tuple | None:
    """(feature, bin) of the best drawn split of a leaf; the first of equal ones, None if none is allowed.  counts: f, bin, y, w, n."""
    best, found = 0.0, None
    features, us = drawn(s.seed, tree, node, len(edges), some)
    for f, u in zip(features.tolist(), us.tolist(), strict=True):
        own = counts[counts["f"] == f]
        low, high = int(own["bin"].min()), int(own["bin"].max())
        if low == high:
            continue
        cut = threshold(u, low, high, edges[f])
        left = (own["bin"] <= cut).to_numpy()
        y, w, n = (own[c].to_numpy() for c in ("y", "w", "n"))
        if min(n[left].sum(), n[~left].sum()) < s.leaf:
            continue
        a, b = (np.bincount(y[side], w[side], n_classes) for side in (left, ~left))
        gain = round(gini(a + b) - gini(a) - gini(b), 9)
        if gain > best:
            best, found = gain, (f, cut)
    return found


_COUNTS = "tree int, node int, f int, bin int, y int, w double, n long"


def _counter(trees: dict[int, Tree], open_: dict[int, list[int]], n_features: int, some: int, s: Settings):
    chosen = {(t, node): drawn(s.seed, t, node, n_features, some)[0] for t, nodes in open_.items() for node in nodes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, w = (batch.column(i).to_numpy() for i in range(2))
            x = matrix(batch.column(2), np.uint8, n_features)
            for t, nodes in open_.items():
                place = np.full(len(trees[t].feature), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[trees[t].leaf_of(x)]
                rows = np.flatnonzero(at >= 0)
                if not len(rows):
                    continue
                f = np.array([chosen[t, node] for node in nodes])[at[rows]]  # rows x drawn features
                node = np.broadcast_to(np.array(nodes)[at[rows], None], f.shape)
                key = np.stack([node, f, x[rows[:, None], f], np.broadcast_to(y[rows, None], f.shape)], axis=-1).reshape(-1, 4).astype(np.int64)
                code = ((key[:, 0] * n_features + key[:, 1]) * 256 + key[:, 2]) * 4096 + key[:, 3]
                _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
                weights = np.broadcast_to(w[rows, None], f.shape).ravel()
                columns = [np.full(len(first), t), *key[first].T, np.bincount(inverse, weights), np.bincount(inverse)]
                kinds = [pa.int32()] * 5 + [pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds, strict=True)], names=["tree", "node", "f", "bin", "y", "w", "n"])

    return run


def fit(df: DataFrame, features: Sequence[str], label: str, n_classes: int, settings: Settings, weight: str | None = None, edges: Sequence[Sequence[float]] | None = None) -> Forest:
    """A forest of label (class numbers from 0)."""
    s, features = settings, list(features)
    edges = [list(e) for e in edges] if edges is not None else bin_edges(df, features, s.bins)
    some = min(len(features), s.features or max(1, int(np.sqrt(len(features)))))
    rows = df.select(F.col(label).cast("int").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], blobs(binned([numbers(c) for c in b.columns[2:]], edges))], names=["y", "w", "x"])

    table = written(rows.mapInArrow(packed, "y int, w double, x binary"), "binned")

    def split(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
        tree, node = (int(k) for k in key)
        one = counts[counts["f"] == counts["f"].iloc[0]]  # every drawn feature counts the same rows
        total = np.bincount(one["y"], one["w"], n_classes)
        found = split_of(counts, tree, node, edges, n_classes, some, s) if (total > 0).sum() > 1 else None
        f, cut = found or (-1, -1)
        return pd.DataFrame({"tree": [tree], "node": [node], "f": [f], "bin": [cut], "total": [total.tolist()]})

    trees = {t: Tree() for t in range(s.trees)}
    shares: dict[int, dict[int, list[float]]] = {t: {} for t in trees}
    for begin in range(0, s.trees, s.group):
        open_ = {t: [0] for t in range(begin, min(begin + s.group, s.trees))}
        for level in range(s.depth + 1):
            counts = table.mapInArrow(_counter({t: trees[t] for t in open_}, open_, len(features), some, s), _COUNTS).groupBy("tree", "node", "f", "bin", "y").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
            found = counts.groupBy("tree", "node").applyInPandas(split, "tree int, node int, f int, bin int, total array<double>").orderBy("tree", "node").collect()  # a row for each open leaf
            following: dict[int, list[int]] = {}
            for r in found:
                shares[r["tree"]][r["node"]] = (np.array(r["total"]) / max(sum(r["total"]), 1e-300)).tolist()
                if r["f"] >= 0 and level < s.depth:
                    following.setdefault(r["tree"], []).extend(trees[r["tree"]].grow(r["node"], r["f"], r["bin"]))
            open_ = following
            if not open_:
                break
    even = [1 / n_classes] * n_classes
    return Forest(features, edges, list(trees.values()), [[shares[t].get(node, even) for node in range(len(tree.feature))] for t, tree in trees.items()])


def save(model: Forest, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Forest:
    return Forest.from_json(spark.read.text(path).first()[0])
