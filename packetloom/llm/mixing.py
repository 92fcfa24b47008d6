"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down a tree (domains, their languages, their sources): each node's share follows its
weight among its siblings.  What a child can't fill within `max_epochs` passes over its documents is offered to its
siblings in proportion to their weights, again and again, before the rest is handed up and offered to the
siblings of its parent.

A leaf with a target of T tokens and a supply of A takes T // A whole epochs and a prefix of one more; each
epoch has its own order by a seeded hash.  The prefix is the longest run of documents from the
beginning of that order whose tokens don't exceed what is left of T.  It is found with a histogram over hash
ranges, so that only the one range in which a leaf's target falls is sorted.

Defined results: a null level value is a child of its own; a null text has no tokens; documents without tokens are
taken once with every whole epoch; weights missing from the table count as 1, a weight of 0 takes
nothing; keys may be null or repeated, as the text is part of the order; exact repeats of a row stand or fall
together; an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialize

#: Leaves that a tree may have (they are planned on the driver); a leaf's hashes fall into 2 ** (64 - RANGE_SHIFT) ranges.
MAX_LEAVES, RANGE_SHIFT = 100_000, 52
_OWN = "_mix_"


@dataclass
class Node:
    weight: float
    path: tuple
    supply: float = 0.0
    target: float = 0.0
    children: list[Node] = field(default_factory=list)


def share_out(amount: float, nodes: Sequence[Node], limits: Mapping[int, float]) -> dict[int, float]:
    """amount among nodes by weight, none above its limit; what some can't take goes to the others."""
    given = dict.fromkeys(range(len(nodes)), 0.0)
    still = [i for i in given if nodes[i].weight > 0 and limits[i] > 0]
    while amount > 1e-9 and still:
        total = sum(nodes[i].weight for i in still)
        full = [i for i in still if given[i] + amount * nodes[i].weight / total >= limits[i]]
        if not full:
            for i in still:
                given[i] += amount * nodes[i].weight / total
            break
        for i in full:  # these are filled; the others share what remains
            amount -= limits[i] - given[i]
            given[i] = limits[i]
        still = [i for i in still if i not in set(full)]
    return given


def capacity(node: Node, max_epochs: float) -> float:
    """Tokens that a node can take: children of weight 0 take none."""
    if not node.children:
        return node.supply * max_epochs
    return sum(capacity(c, max_epochs) for c in node.children if c.weight > 0)


def assign(node: Node, amount: float, max_epochs: float) -> None:
    """Targets of all nodes below.  A node gets no more than it can take: its shortage went to its siblings, and to the
    siblings of its ancestors only if those could not take it either."""
    node.target = min(amount, capacity(node, max_epochs))
    if node.children:
        limits = {i: capacity(c, max_epochs) for i, c in enumerate(node.children)}
        for i, given in share_out(node.target, node.children, limits).items():
            assign(node.children[i], given, max_epochs)


def tree(leaves: Sequence[tuple[tuple, float]], weights: Mapping[tuple, float]) -> Node:
    root, nodes = Node(1.0, ()), {}
    nodes[()] = root
    for path, supply in sorted(leaves, key=lambda x: tuple((v is not None, str(v)) for v in x[0])):
        for depth in range(1, len(path) + 1):
            here = path[:depth]
            if here not in nodes:
                nodes[here] = Node(float(weights.get(here, 1.0)), here)
                nodes[here[:-1]].children.append(nodes[here])
        nodes[path].supply = supply
    return root


def leaves_of(node: Node):
    return [node] if not node.children else [leaf for c in node.children for leaf in leaves_of(c)]


def plan(supplies: DataFrame, levels: Sequence[str], weights: Mapping[tuple, float], budget: float, max_epochs: int) -> list[tuple]:
    """(level values, supply, target) of each leaf."""
    rows = supplies.limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    root = tree([(tuple(r[c] for c in levels), float(r["supply"] or 0)) for r in rows], weights)
    if not rows:
        return []
    assign(root, budget, max_epochs)
    return [(leaf.path, int(leaf.supply), int(leaf.target + 1e-6)) for leaf in leaves_of(root)]


def word_tokens(text: str = "text") -> Column:
    """Number of words (runs without white space)."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("long")


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple, float], budget: float, tokens: Column, key: str = "doc_id", text: str = "text", max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """Rows of docs with n_tokens and epoch (from 0; columns of these names are replaced), each as often as epochs
    take it.

    levels: name and value of each level from the root on; weights: by path of level values; budget: tokens in
    all, or if at most 1 a share of the tokens of docs."""
    names = [f"{_OWN}level{i}" for i in range(len(levels))]
    of_row = [v.cast("string").alias(n) for n, v in zip(names, levels.values(), strict=True)]
    of_row += [F.xxhash64(F.col(key), F.col(text)).alias(f"{_OWN}row"), F.coalesce(tokens.cast("long"), F.lit(0)).alias(f"{_OWN}tokens")]
    slim = materialize(docs.select(*of_row), "mix-rows")
    supplies = slim.groupBy(*names).agg(F.sum(f"{_OWN}tokens").alias("supply"))
    if budget <= 1:
        budget *= float(slim.agg(F.sum(f"{_OWN}tokens")).first()[0] or 0)
    leaves = [(*path, *(divmod(target, supply) if supply else (0, 0))) for path, supply, target in plan(supplies, names, weights, budget, max_epochs)]
    schema = ", ".join(f"{n} string" for n in names) + f", {_OWN}epochs long, {_OWN}rest long"
    table = docs.sparkSession.createDataFrame(leaves, schema)
    cut = cuts(slim, table, names, seed)
    chosen = docs.select("*", *of_row)
    chosen = chosen.join(F.broadcast(cut), _same(chosen, cut, names), "inner").drop(*[cut[n] for n in names])
    order = _order(seed)
    taken = F.coalesce(F.shiftright(order, RANGE_SHIFT) < F.col(f"{_OWN}edge"), F.lit(False)) | F.coalesce(order <= F.col(f"{_OWN}last"), F.lit(False))
    times = (F.col(f"{_OWN}epochs") + taken.cast("long")).cast("int")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_tokens", "epoch")]
    return chosen.withColumn(f"{_OWN}times", times).where(F.col(f"{_OWN}times") > 0).select(*kept, F.col(f"{_OWN}tokens").alias("n_tokens"), F.explode(F.sequence(F.lit(0), F.col(f"{_OWN}times") - 1)).alias("epoch"))


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def _order(seed: int) -> Column:
    """Place of a row in the epoch of its leaf of which a prefix is taken."""
    return F.xxhash64(F.lit(seed), F.col(f"{_OWN}epochs"), F.col(f"{_OWN}row"))


def cuts(slim: DataFrame, leaves: DataFrame, names: Sequence[str], seed: int) -> DataFrame:
    """The leaves (at most MAX_LEAVES) with the hash range in which the target falls and the last place taken in it.
    Ranges before it are taken whole; rows of one place are taken together or not at all."""
    met = slim.join(F.broadcast(leaves), _same(slim, leaves, names), "inner").drop(*[leaves[n] for n in names]).where(F.col(f"{_OWN}rest") > 0)
    met = met.withColumn("place", _order(seed)).withColumn("range", F.shiftright("place", RANGE_SHIFT))
    ranges = met.groupBy(*names, f"{_OWN}rest", "range").agg(F.sum(f"{_OWN}tokens").alias("n"))
    running = ranges.withColumn("upto", F.sum("n").over(Window.partitionBy(*names).orderBy("range")))
    edges = running.where(F.col("upto") > F.col(f"{_OWN}rest")).groupBy(*names).agg(F.min("range").alias(f"{_OWN}edge"), F.min(F.col("upto") - F.col("n")).alias("before"))
    inside = met.join(F.broadcast(edges), _same(met, edges, names) & (met["range"] == edges[f"{_OWN}edge"]), "inner").drop(*[edges[n] for n in names])
    places = inside.groupBy(*names, f"{_OWN}rest", "before", "place").agg(F.sum(f"{_OWN}tokens").alias("n"))
    fits = places.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*names).orderBy("place"))).where(F.col("upto") <= F.col(f"{_OWN}rest"))
    lasts = fits.groupBy(*names).agg(F.max("place").alias(f"{_OWN}last"))
    with_edge = leaves.join(edges.drop("before"), _same(leaves, edges, names), "left").drop(*[edges[n] for n in names])
    return with_edge.join(lasts, _same(with_edge, lasts, names), "left").drop(*[lasts[n] for n in names])
