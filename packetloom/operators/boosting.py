"""Histogram gradient boosting for several classes, with softmax, on rows that stay distributed.

Features become bin numbers once, and equal rows one row with their number, unless samples tell rows apart by their keys: what a
round reads then grows with the distinct rows.  In each round one tree for each class grows at the same time: a job adds up the
gradients by class, leaf, feature and bin (in numpy within a task, then by a shuffled aggregation), and Spark picks each
leaf's best split.  The driver holds trees, never rows.

Trees grow best leaf first.  A leaf's best split doesn't depend on other leaves, so a job evaluates all leaves that growth with
what is known reaches, and growth is then replayed: as many jobs as a tree has levels, not as it has leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from .quantiles import finite

#: Sums that a task holds at once: leaves beyond wait for the next job.  Rounds after which rows are written with their margins.
CELLS, WRITE_AFTER = 2_000_000, 8
ACCURACY = 10_000


@dataclass(frozen=True)
class Settings:
    """leaves and depth: limits of a tree (None: no limit); share and features: of rows for a round and of features for a tree; leaf:
    rows of a leaf at least, weight: sum of second derivatives; penalty: of squared leaf values; curvature: factor of the second
    derivatives; prior: begin with the classes' frequencies; patience: rounds without a better loss on a held out share of the rows
    after which it ends (None: never)."""

    rounds: int = 50
    step: float = 0.1
    depth: int | None = 6
    leaves: int | None = None
    share: float = 1.0
    features: float = 1.0
    bins: int = 256
    leaf: int = 1
    weight: float = 1.0
    penalty: float = 1.0
    curvature: float = 2.0
    prior: bool = False
    patience: int | None = None
    held_out: float = 0.1
    tolerance: float = 1e-7
    seed: int = 42


@dataclass
class Tree:
    """Nodes by number; feature -1 marks a leaf.  A row goes left if its bin is at most bin, its value at most the edge."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def grow(self, node: int, feature: int, bin_: int) -> tuple[int, int]:
        self.feature[node], self.bin[node] = feature, bin_
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column += [empty, empty]
        return self.left[node], self.right[node]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of bin numbers."""
        feature, bin_, left, right = (np.array(c) for c in (self.feature, self.bin, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(feature[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= bin_[node], left[node], right[node])
            inner = inner[feature[at[inner]] >= 0]
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(x)]


@dataclass
class Boosted:
    """A fitted model: edges of each feature's bins, margins to begin with, trees by round and class, losses of held out rows."""

    features: list[str]
    edges: list[list[float]]
    base: list[float]
    rounds: list[list[Tree]]
    losses: list[float] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(x), 1))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.margin(x)
        return out

    def transform(self, df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        """df with probabilities and prediction (the first most likely class).  columns: other names of the features."""
        edges, margins = self.edges, self.margins

        @F.arrow_udf("array<double>")
        def probabilities(*values: pa.Array) -> pa.Array:
            return lists(softmax(margins(binned([numbers(v) for v in values], edges))))

        named = df.withColumn("probabilities", probabilities(*[F.col(f"`{c}`").cast("double") for c in columns or self.features]))
        return named.withColumn("prediction", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("double"))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Boosted:
        found = json.loads(text)
        return cls(found["features"], found["edges"], found["base"], [[Tree(**t) for t in trees] for trees in found["rounds"]], found["losses"])


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def binned(values: Sequence[np.ndarray], edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin numbers of columns of values: how many edges are smaller.  A missing or infinite value lies below all."""
    return np.stack([np.searchsorted(np.asarray(e), np.where(np.isfinite(v), v, -np.inf), "left") for v, e in zip(values, edges, strict=True)], axis=1).astype(np.uint8)


def numbers(values: pa.Array) -> np.ndarray:
    """A column as doubles, NaN where it is null."""
    return values.to_numpy(zero_copy_only=False).astype(np.float64)


def lists(found: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32()), pa.array(found.ravel()))


def blobs(found: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes, in one piece."""
    width = found.shape[1] * found.itemsize
    ends = np.arange(len(found) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(found).tobytes())])


def matrix(rows: pa.Array, kind: type, width: int) -> np.ndarray:
    """What blobs made of a matrix of width columns; rows hold no null."""
    rows = rows.cast(pa.binary())
    at = np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1, rows.offset * 4) if len(rows) else np.zeros(1, np.int32)
    return np.frombuffer(rows.buffers()[2], kind, len(rows) * width, int(at[0])).reshape(-1, width) if at[-1] > at[0] else np.zeros((len(rows), width), kind)


def bin_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Upper edges of the bins but the last, from sketches of bounded size of all columns in one pass.  Where values are missing,
    the first edge lies below all others, so that a split can tell them apart."""
    shares = [i / (bins - 1) for i in range(1, bins)]
    xs = [finite(F.col(f"`{c}`")) for c in features]
    row = df.agg(*[x for i, c in enumerate(xs) for x in (F.percentile_approx(c, [0.0, *shares], ACCURACY).alias(f"e{i}"), F.count_if(c.isNull()).alias(f"m{i}"))]).first()
    out = []
    for i in range(len(xs)):
        found = row[f"e{i}"] or []
        inner = sorted({x for x in found[1:] if x < found[-1]})
        out.append([float(np.nextafter(found[0], -np.inf)), *inner] if found and row[f"m{i}"] else inner)
    return out


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 that follow from row keys and a salt."""
    x = keys.view(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


class _Rows:
    """Batches as arrays: keys, classes, weights, numbers of equal rows, bin numbers, margins without the trees that came since they
    were written."""

    def __init__(self, batch: pa.RecordBatch, n_features: int, n_classes: int):
        self.key, self.y, self.w, self.n = (batch.column(i).to_numpy() for i in range(4))
        self.x = matrix(batch.column(4), np.uint8, n_features)
        self.margins = matrix(batch.column(5), np.float64, n_classes).copy()

    def add(self, rounds: Sequence[Sequence[Tree]]) -> None:
        for trees in rounds:
            for k, tree in enumerate(trees):
                self.margins[:, k] += tree.margin(self.x)


_HISTOGRAM = "k int, node int, f int, bin int, g double, h double, n long"


def _histogram(since: list[list[Tree]], trees: list[Tree], open_: list[dict[int, int]], chosen: list[list[int]], s: Settings, round_: int, n_features: int):
    """Sums of first and second derivatives and rows by class, open leaf, feature and bin; at class -1 the loss of held out rows."""
    n_classes, loss_too = len(trees), len(trees[0].feature) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(o), len(c), s.bins, 3)) for o, c in zip(open_, chosen, strict=True)]
        loss = np.zeros(2)
        for batch in batches:
            rows = _Rows(batch, n_features, n_classes)
            rows.add(since)
            p = softmax(rows.margins)
            held = _uniform(rows.key, s.seed) < s.held_out if s.patience is not None else np.zeros(len(p), bool)
            if loss_too and held.any():
                w = rows.w * rows.n
                loss += (-(w * np.log(np.maximum(p[np.arange(len(p)), rows.y], 1e-300)))[held].sum(), w[held].sum())
            used = ~held & (_uniform(rows.key, s.seed + 1 + round_) < s.share if s.share < 1 else True)
            for k in range(n_classes):
                if not open_[k]:
                    continue
                place = np.full(len(trees[k].feature), -1)
                place[list(open_[k])] = list(open_[k].values())
                at = np.where(used, place[trees[k].leaf_of(rows.x)], -1)
                mine = np.flatnonzero(at >= 0)
                n = rows.n[mine]
                g = n * rows.w[mine] * (p[mine, k] - (rows.y[mine] == k))
                h = n * np.maximum(s.curvature * rows.w[mine] * p[mine, k] * (1 - p[mine, k]), 1e-16)
                for j, f in enumerate(chosen[k]):
                    cell = at[mine] * s.bins + rows.x[mine, f]
                    for i, weights in enumerate((g, h, n)):
                        sums[k][:, j, :, i] += np.bincount(cell, weights, len(open_[k]) * s.bins).reshape(-1, s.bins)
        for k, found in enumerate(sums):
            leaf, j, bin_ = np.nonzero(found[..., 2])
            if len(leaf):
                node, f = np.array(list(open_[k]))[leaf], np.array(chosen[k])[j]
                g, h, n = (found[leaf, j, bin_, i] for i in range(3))
                yield _batch(np.full(len(leaf), k), node, f, bin_, g, h, n)
        if loss[1]:
            yield _batch(*(np.array([v]) for v in (-1, 0, 0, 0, *loss, 1)))

    return run


def _batch(k, node, f, bin_, g, h, n) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.float64()] * 2 + [pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(t.to_pandas_dtype()), t) for c, t in zip((k, node, f, bin_, g, h, n), kinds, strict=True)], names=["k", "node", "f", "bin", "g", "h", "n"])


def best_splits(histogram: DataFrame, s: Settings) -> DataFrame:
    """k, node, g, h, n and the best split (gain, f, bin, and g, h, n of its left side; null if none has a gain).  Of equal
    gains the first feature and bin."""
    dealt = histogram.repartition("k", "node", "f")  # tasks have added up their own: one exchange serves the sums and the windows
    cells = dealt.groupBy("k", "node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    of = Window.partitionBy("k", "node", "f")  # a row for each bin
    upto = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sides = cells.select("k", "node", "f", "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in "ghn"], *[F.sum(c).over(of).alias(c) for c in "ghn"])
    worth = lambda g, h: g * g / (h + s.penalty)
    rg, rh, rn = (F.col(c) - F.col(f"l{c}") for c in "ghn")
    gain = F.round(0.5 * (worth(F.col("lg"), F.col("lh")) + worth(rg, rh) - worth(F.col("g"), F.col("h"))), 9)
    fits = (F.col("ln") >= s.leaf) & (rn >= s.leaf) & (rn > 0) & (F.col("lh") >= s.weight) & (rh >= s.weight) & (gain > 0)
    split = F.when(fits, F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("bin")).alias("bin"), "lg", "lh", "ln"))
    return sides.groupBy("k", "node").agg(F.max(split).alias("split"), *[F.max_by(c, F.struct(-F.col("f"), "bin")).alias(c) for c in "ghn"])


def _replay(known: Mapping[int, dict], s: Settings, tree: Tree, depth: Mapping[int, int]) -> list[int]:
    """Best leaf first over what is known of a tree's nodes: the nodes to split, in order.  A node whose children aren't known
    yet is split as if they had no gain."""
    limit = s.leaves or 1 << (s.depth or 30)
    heap = [(-known[0]["split"]["gain"], 0)] if known[0]["split"] else []
    heapify(heap)
    order: list[int] = []
    while heap and len(order) + 1 < limit:
        _, node = heappop(heap)
        order.append(node)
        if tree.feature[node] >= 0:
            for child in (tree.left[node], tree.right[node]):
                if child in known and known[child]["split"]:
                    heappush(heap, (-known[child]["split"]["gain"], child))
    return order


class _Growing:
    """A tree with all splits that were ever considered; cut() leaves those that growth takes."""

    def __init__(self) -> None:
        self.tree, self.depth, self.known, self.stats = Tree(), {0: 0}, {}, {}
        self.open = [0]

    def learn(self, row, s: Settings) -> None:
        split = row["split"]
        self.stats[row["node"]] = (row["g"], row["h"])
        deep = s.depth is not None and self.depth[row["node"]] >= s.depth
        self.known[row["node"]] = {"split": split.asDict() if split is not None and not deep else None}

    def advance(self, s: Settings) -> None:
        """Opens the children of nodes that growth splits and that have none yet."""
        for node in self.open:
            self.known.setdefault(node, {"split": None})  # no row reached it
        self.open = []
        for node in _replay(self.known, s, self.tree, self.depth):
            if self.tree.feature[node] < 0:
                split, (g, h) = self.known[node]["split"], self.stats[node]
                left, right = self.tree.grow(node, -split["f"], -split["bin"])
                self.stats[left], self.stats[right] = (split["lg"], split["lh"]), (g - split["lg"], h - split["lh"])
                for child in (left, right):
                    self.depth[child] = self.depth[node] + 1
                    if s.depth is not None and self.depth[child] >= s.depth:
                        self.known[child] = {"split": None}
                    else:
                        self.open.append(child)

    def cut(self, s: Settings) -> Tree:
        out, new = Tree(), {0: 0}
        for node in _replay(self.known, s, self.tree, self.depth) if 0 in self.known else []:
            new[self.tree.left[node]], new[self.tree.right[node]] = out.grow(new[node], self.tree.feature[node], self.tree.bin[node])
        for node, place in new.items():
            if out.feature[place] < 0 and node in self.stats:
                g, h = self.stats[node]
                out.value[place] = -s.step * g / (h + s.penalty)
        return out


def _grow(rows: DataFrame, since: list[list[Tree]], n_classes: int, s: Settings, round_: int, n_features: int) -> tuple[list[Tree], float | None]:
    """One round: a tree for each class, and the loss of held out rows before it."""
    rng = np.random.default_rng([s.seed, round_])
    some = max(1, round(s.features * n_features))
    chosen = [sorted(rng.choice(n_features, some, replace=False).tolist()) for _ in range(n_classes)]
    growing, loss = [_Growing() for _ in range(n_classes)], None
    room = max(n_classes, CELLS // (some * s.bins))  # leaves of a job
    waiting = [(k, 0) for k in range(n_classes)]
    while waiting:
        turn, waiting = waiting[:room], waiting[room:]
        open_ = [{node: i for i, node in enumerate(n for c, n in turn if c == k)} for k in range(n_classes)]
        trees = [t.tree for t in growing]
        histogram = rows.mapInArrow(_histogram(since, trees, open_, chosen, s, round_, n_features), _HISTOGRAM)
        for row in best_splits(histogram, s).collect():  # a row for each open leaf
            if row["k"] < 0:
                loss = row["g"] / row["h"]
            else:
                growing[row["k"]].learn(row, s)
        if not waiting:
            for t in growing:
                t.advance(s)
            waiting = [(k, node) for k, t in enumerate(growing) for node in t.open]
    return [t.cut(s) for t in growing], loss


def fit(df: DataFrame, features: Sequence[str], label: str, n_classes: int, settings: Settings, weight: str | None = None, key: str | None = None, edges: Sequence[Sequence[float]] | None = None) -> Boosted:
    """A model of label (class numbers from 0).  key: a long column from which samples follow; unless given, a hash of the row."""
    s, features = settings, list(features)
    if s.bins > 256:
        raise ValueError("at most 256 bins")
    edges = [list(e) for e in edges] if edges is not None else bin_edges(df, features, s.bins)
    ident = F.col(key).cast("long") if key else F.xxhash64(*[f"`{c}`" for c in features], label)
    rows = df.select(ident.alias("key"), F.col(label).cast("int").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    base = np.zeros(n_classes)
    if s.prior:
        sums = {r["y"]: r["w"] for r in rows.groupBy("y").agg(F.sum("w").alias("w")).collect()}  # a row for each class
        share = np.array([sums.get(k, 0.0) for k in range(n_classes)]) / max(sum(sums.values()), 1e-300)
        base = np.log(np.maximum(share, 1e-15))
        base -= base.mean()
    schema = "key long, y int, w double, n long, x binary, m binary"
    names = ["key", "y", "w", "n", "x", "m"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], blobs(binned([numbers(c) for c in b.columns[3:]], edges))], names=["key", "y", "w", "x"])

    def moved(since: list[list[Tree]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                r = _Rows(b, len(features), n_classes)
                r.add(since)
                yield pa.RecordBatch.from_arrays([*b.columns[:5], blobs(r.margins)], names=names)

        return run

    each = rows.mapInArrow(packed, "key long, y int, w double, x binary")
    if s.share >= 1 and s.patience is None:  # no sample: equal rows stay together in all that follows
        each = each.groupBy("y", "w", "x").agg(F.lit(0).cast("long").alias("key"), F.count(F.lit(1)).alias("n"))
    else:
        each = each.withColumn("n", F.lit(1).cast("long"))
    table = written(each.withColumn("m", F.lit(base.tobytes())).select(*names), "binned")
    model, since = Boosted(features, edges, base.tolist(), []), []
    for round_ in range(s.rounds):
        trees, loss = _grow(table, since, n_classes, s, round_, len(features))
        if loss is not None:
            model.losses.append(loss)
            if _settled(model.losses, s):
                break
        if all(t.feature == [-1] and not t.value[0] for t in trees):
            break
        model.rounds.append(trees)
        since.append(trees)
        if len(since) == WRITE_AFTER:
            table, since = written(table.mapInArrow(moved(since), schema), f"margins-{round_}"), []
    return model


def _settled(losses: Sequence[float], s: Settings) -> bool:
    """Whether none of the last rounds has a smaller loss than the one before them."""
    if s.patience is None or len(losses) <= s.patience:
        return False
    return min(losses[-s.patience :]) >= losses[-s.patience - 1] - s.tolerance


def save(model: Boosted, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Boosted:
    return Boosted.from_json(spark.read.text(path).first()[0])
