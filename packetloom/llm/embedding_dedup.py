"""Near-duplicate embeddings by collision-counting projections.

Unit vectors are projected on many random lines.  On each line a window is centred on every query; a pair's
count is the number of windows in which it collides.  Two vectors at the threshold differ on a line by a normal
deviate of standard deviation distance / sqrt(dimension), so the least count of a pair worth verifying follows from
the recall wanted; such pairs are verified by their cosine in double precision.

Vectors of a label are sorted along the first line into chunks of about CHUNK; two chunks meet only if
their stretches of that line are within MARGIN deviations, and the meeting of two chunks is one bounded piece
of work.  It returns how many links each vector has and a forest of them, never the pairs themselves.

Equal vectors are one node from the start, with a weight.

Defined results: vectors that are null, zero or of null or non-finite components, and those of a null label, are
linked with nothing; vectors of different dimension are not compared; a null or repeated vec_id is a row of its own for
links, and components carry the smallest vec_id that isn't null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize, shuffle_partitions
from .components import components

COSINE = 0.98
#: Random lines; half-width of a window in standard deviations of a pair at the threshold; recall of the count.
LINES, WIDTH, RECALL = 24, 2.5, 0.9999
#: Vectors of a chunk; deviations on the first line beyond which chunks don't meet; bins of the first line.
CHUNK, MARGIN, BINS = 2_000, 4.5, 512
#: Pairs whose cosines are computed at a time.
VERIFIED = 50_000
_SEED = 20_240


def lines(dimension: int) -> np.ndarray:
    """LINES unit directions, the same for a dimension everywhere."""
    drawn = np.random.default_rng([_SEED, dimension]).standard_normal((dimension, LINES))
    return drawn / np.linalg.norm(drawn, axis=0)


def deviation(dimension: int, cosine: float = COSINE) -> float:
    """Standard deviation on a line of the difference of two unit vectors of this cosine."""
    return math.sqrt(2 - 2 * cosine) / math.sqrt(dimension)


def least_count(recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability recall or more."""
    p = math.erf(WIDTH / math.sqrt(2))
    reached, count = 0.0, LINES + 1
    while reached < recall and count > 0:
        count -= 1
        reached += math.comb(LINES, count) * p**count * (1 - p) ** (LINES - count)
    return count


def nodes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, label, node (null: linked with nothing), dimension, bin, place, vector (bytes of float64)."""
    schema = "vec_id long, label long, node long, dimension int, bin int, place double, vector binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for label, vector in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                row: tuple = (None,) * 5
                if label is not None and vector.is_valid and len(vector.values) and not vector.values.null_count:
                    x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    largest = float(np.abs(x).max()) if np.isfinite(x).all() else 0.0
                    if largest > 0:
                        d, node = len(x), xxhash.xxh64_intdigest(x.tobytes() + label.to_bytes(8, "little", signed=True))
                        x = x / largest  # so that no square overflows or vanishes
                        norm = math.sqrt(float(x @ x))
                        first = directions.setdefault(d, lines(d)[:, 0])
                        place = float(x @ first) / norm
                        row = (node - 2**64 if node >= 2**63 else node, d, int((place + 1) * BINS / 2), place, x.tobytes())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["vec_id", "label", "node", "dimension", "bin", "place", "vector"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").mapInArrow(run, schema)


def chunked(nodes: DataFrame) -> DataFrame:
    """nodes with chunk: runs of bins of about CHUNK vectors of a label; a larger bin is split by node."""
    group = ["label", "dimension"]
    counts = nodes.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))  # BINS rows a label at most
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("bin"))
    dealt = counts.select(*group, "bin", F.floor((upto - 1) / CHUNK).alias("run"), F.ceil(F.col("n") / CHUNK).alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(0)
    return nodes.join(dealt, [*group, "bin"]).withColumn("chunk", F.xxhash64(*group, "run", F.when(F.col("parts") > 1, F.col("bin")), part))


def compare(a: np.ndarray, b: np.ndarray, same: bool, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of the linked rows of a and b, each pair once if they are the same."""
    d = a.shape[1]
    unit_a, unit_b = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] for x in (a, b))
    directions, width = lines(d), WIDTH * deviation(d, cosine)
    on_a, on_b = unit_a @ directions, unit_b @ directions
    order = np.argsort(on_b, axis=0)
    found_i, found_j = [], []
    least = least_count()
    rows = max(1, 4_000_000 // max(1, len(b)))
    for begin in range(0, len(a), rows):
        count = np.zeros((min(rows, len(a) - begin), len(b)), np.uint8)
        for k in range(LINES):
            sorted_b = on_b[order[:, k], k]
            lo = np.searchsorted(sorted_b, on_a[begin : begin + rows, k] - width)
            hi = np.searchsorted(sorted_b, on_a[begin : begin + rows, k] + width, side="right")
            place = np.empty(len(b), np.int64)
            place[order[:, k]] = np.arange(len(b))
            count += (place >= lo[:, None]) & (place < hi[:, None])
        i, j = np.nonzero(count >= least)
        i = i + begin
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), VERIFIED):
            x, y = i[at : at + VERIFIED], j[at : at + VERIFIED]
            linked = np.einsum("ij,ij->i", unit_a[x], unit_b[y]) >= cosine
            found_i.append(x[linked])
            found_j.append(y[linked])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n by the links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], least)
        np.minimum.at(root, root[j], least)
        root = root[root]
        if (root == before).all():
            return root


def links(nodes: DataFrame) -> DataFrame:
    """node, other, n: how many vectors node is linked with (other null), or a link of a forest (n 0)."""
    placed = materialize(chunked(nodes), "embedding-chunks")

    def gather(_, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "dimension": pdf["dimension"].iloc[:1], "nodes": [pdf["node"].to_numpy(np.int64).tobytes()], "weights": [pdf["weight"].to_numpy(np.int64).tobytes()], "vectors": [b"".join(pdf["vector"])]})

    blocks = placed.select("chunk", "dimension", "node", "weight", "vector").groupBy("chunk").applyInPandas(lambda k, pdf: gather(k, pdf), "chunk long, dimension int, nodes binary, weights binary, vectors binary")
    blocks = materialize(blocks, "embedding-blocks")
    stretches = placed.groupBy("label", "dimension", "chunk").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    x, y = stretches.alias("x"), stretches.alias("y")
    reach = F.lit(MARGIN * math.sqrt(2 - 2 * COSINE)) / F.sqrt(F.col("x.dimension"))
    near = (F.col("x.label") == F.col("y.label")) & (F.col("x.dimension") == F.col("y.dimension")) & (F.col("x.chunk") <= F.col("y.chunk"))
    near = near & (F.col("x.lo") <= F.col("y.hi") + reach) & (F.col("y.lo") <= F.col("x.hi") + reach)
    meetings = x.join(y, near).select(F.col("x.chunk").alias("a"), F.col("y.chunk").alias("b"))
    side = lambda c: blocks.select(F.col("chunk").alias(c), F.col("dimension").alias("dimension" if c == "a" else "_d"), *[F.col(k).alias(f"{k}_{c}") for k in ("nodes", "weights", "vectors")])
    met = meetings.join(side("a"), "a").join(side("b"), "b").drop("_d").repartition(4 * shuffle_partitions(nodes.sparkSession), "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                na, wa, nb, wb = (np.frombuffer(row[f"{k}_{c}"], np.int64) for c in "ab" for k in ("nodes", "weights"))
                va, vb = (np.frombuffer(row[f"vectors_{c}"], np.float64).reshape(-1, row["dimension"]) for c in "ab")
                same = row["a"] == row["b"]
                i, j = compare(va, vb, same)
                if not len(i):
                    continue
                shift = 0 if same else len(na)
                every = na if same else np.concatenate([na, nb])
                weight = wa if same else np.concatenate([wa, wb])
                n = np.bincount(i, weight[j + shift], len(every)) + np.bincount(j + shift, weight[i], len(every))
                root = roots(len(every), i, j + shift)
                some, moved = np.flatnonzero(n), np.flatnonzero(root != np.arange(len(every)))
                node = np.concatenate([every[some], every[moved]])
                other = pa.array(np.concatenate([every[some], every[root[moved]]]), pa.int64(), mask=np.arange(len(node)) < len(some))
                yield pa.RecordBatch.from_arrays([pa.array(node), other, pa.array(np.concatenate([n[some], np.zeros(len(moved))]).astype(np.int64))], names=["node", "other", "n"])

    return materialize(met.mapInArrow(run, "node long, other long, n long"), "embedding-links")


def embedding_dedup(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = materialize(nodes_of(vectors), "embedding-nodes")
    nodes = rows.where("node is not null").groupBy("label", "dimension", "node").agg(F.count(F.lit(1)).alias("weight"), F.first("bin").alias("bin"), F.first("place").alias("place"), F.first("vector").alias("vector"))
    found = links(nodes)
    joined = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    degree = found.where("other is null").groupBy("node").agg(F.sum("n").alias("linked"))
    sizes = nodes.select("node", "weight")
    placed = rows.select("vec_id", "node").join(sizes, "node", "left").join(degree, "node", "left").join(joined, "node", "left")
    placed = placed.withColumn("component", F.coalesce("component", "node"))
    smallest = placed.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = placed.join(smallest, "component", "left")
    component = F.coalesce("component_id", "vec_id")
    n_links = F.coalesce("linked", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
