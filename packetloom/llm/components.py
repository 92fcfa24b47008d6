"""Connected components of an edge table, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Rounds after which something must be wrong: each round about halves the height of the trees.
MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in edges(a, b), by distributed union-find.

    A round hangs each node's larger neighbours under its smallest one (large star), then each node's smaller
    neighbours under the smallest (small star).  Trees flatten in a logarithmic number of rounds; a node's
    neighbours are only aggregated by minimum, never collected.  Each round is a written table, so lineage
    stays short and a lost executor costs one round at most.  Null nodes are ignored; no edges, no rows."""
    links = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = materialize(links, "links")
    for _ in range(MAX_ROUNDS):
        if _flat(links):
            break
        links = materialize(_star(_star(links, large=True), large=False), "links")
    else:
        raise RuntimeError("components did not converge")
    own = links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(own)


def _flat(links: DataFrame) -> bool:
    """Whether every node of distinct links(hi, lo) hangs under one node only, and that one under none."""
    end = lambda c, under: F.struct(F.col(c).alias("node"), F.lit(under).alias("under"), F.lit(1 - under).alias("over"))
    ends = links.select(F.inline(F.array(end("hi", 1), end("lo", 0))))
    return ends.groupBy("node").agg(F.sum("under").alias("under"), F.max("over").alias("over")).where("under + over > 1").isEmpty()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(hi, lo) after one star operation."""
    if large:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        least = links.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        met = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).join(least, "u")
        out = met.select(F.inline(F.array(F.struct(F.greatest("u", "m").alias("hi"), F.least("u", "m").alias("lo")), F.struct(F.greatest("v", "m").alias("hi"), F.least("v", "m").alias("lo")))))
    return out.where("hi <> lo").distinct()
