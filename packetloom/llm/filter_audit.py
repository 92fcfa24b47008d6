"""Filter interaction audit: which of several filters removes what, in every order of applying them.

Each document gets a mask with one bit for each filter that it fails; all figures of all orders follow from how many
documents of a part have which mask, so the masks are counted once and no order reads the documents again.

The duplicate filter is found by partition refinement: texts are split by their length in code points, then by the hash
of one block after the other (each eight times as long as the one before), and what stands alone in its class drops out
of the next round.  Full texts are compared only within the classes that are left: each member against the text of
the class's smallest id, members of frequent classes in several shares.  Members whose text differs (their hashes collide)
make up the next round of comparisons, until none is left: the result is exact.

Defined results: a null text is empty; a null part counts as the empty string; empty texts are copies of each
other; a null doc_id has no place in the order, so it is never a later copy and makes none; rows of one id are no later
copies of each other, whatever their texts; a document has a label if any of its label rows says so, null labels
say nothing; no rows give no parts; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import known_words, materialize, maybe_known

FILTERS = "ABCDE"
#: Fixed values of the filters: words at least, per cent of distinct words at least, per cent of capitals at most, and
#: characters that no text may hold.
LEAST_WORDS, DISTINCT, CAPITALS, FORBIDDEN = 100, 80, 10, b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Code points of the first block, times that each block is longer than the one before, and blocks that the longest string needs.
FIRST_BLOCK, GROWTH, BLOCKS = 64, 8, 10
#: Classes that count as frequent, at most: those with more than one in so many of all rows, or than so many rows.
SHARES, LEAST_SHARE = 4096, 1000


def _begins() -> list[int]:
    """Where each block begins, and the last one ends."""
    return [FIRST_BLOCK * (GROWTH**k - 1) // (GROWTH - 1) for k in range(BLOCKS + 1)]


def with_blocks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, text, part, n_chars, h0, h1, ...: hashes of a text's blocks, null from its end on."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    at = _begins()
    hashes = [F.when(F.col("n_chars") > a, F.xxhash64(F.substring("text", a + 1, b - a))).alias(f"h{k}") for k, (a, b) in enumerate(zip(at, at[1:]))]
    return whole.withColumn("n_chars", F.length("text")).select("*", *hashes)


def class_of(rounds: int) -> Column:
    """The class after so many blocks; a text that has ended keeps its class."""
    return F.xxhash64("n_chars", *[f"h{k}" for k in range(rounds)])


def _repeated(rows: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows whose class has another row; all such classes with their sizes; from which size on a class is frequent.
    Rows of frequent classes, SHARES classes at most, are known by a broadcast: no task gathers one."""
    least = max(LEAST_SHARE, n_rows // SHARES + 1)
    sizes = materialize(rows.groupBy("class").agg(F.count("*").alias("size")).where("size > 1"), "classes")
    frequent = F.broadcast(sizes.where(F.col("size") >= least).select("class", F.lit(True).alias("frequent")))
    rare = sizes.where(F.col("size") < least).select("class")
    marked = rows.join(frequent, "class", "left")
    in_rare = marked.where("frequent is null").drop("frequent").join(rare, "class", "left_semi")
    return marked.where("frequent").drop("frequent").unionByName(in_rare), sizes, least


def repeated_classes(signed: DataFrame, n_rows: int) -> DataFrame:
    """class, size of the classes of two rows or more that all blocks leave.  signed: doc_id, n_chars, h0, h1, ..."""
    at = _begins()
    live = signed.where("doc_id is not null").withColumn("class", class_of(0))
    ended = []
    for k in range(BLOCKS):
        live, _, _ = _repeated(live, n_rows)
        live = materialize(live, f"refined-{k}")
        ended.append(live.where(F.col("n_chars") <= at[k]).select("class"))
        live = live.where(F.col("n_chars") > at[k])
        if live.isEmpty():
            break
        live = live.withColumn("class", class_of(k + 1))
    else:
        ended.append(live.select("class"))
    left = ended[0]
    for more in ended[1:]:
        left = left.unionByName(more)
    return left.groupBy("class").agg(F.count("*").alias("size")).where("size > 1")


def later_copies(docs: DataFrame, classes: DataFrame, n_rows: int) -> DataFrame:
    """doc_id, text, part of the rows whose text a smaller doc_id has too."""
    least = max(LEAST_SHARE, n_rows // SHARES + 1)
    shares = F.broadcast(classes.where(F.col("size") >= least).select("class", F.ceil(F.col("size") / least).cast("int").alias("shares")))
    texts = with_blocks(docs).where("doc_id is not null").select("doc_id", "text", "part", class_of(BLOCKS).alias("class"))
    texts = maybe_known(texts, "class", known_words(classes, "class")).join(shares, "class", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    found, rounds = None, 0
    while True:
        first = texts.groupBy("class").agg(F.min(F.struct("doc_id", "text")).alias("first"), F.max("shares").alias("shares"))
        first = first.select("class", "first", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        members = texts.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int"))
        met = members.join(first, ["class", "share"])
        same = met.where((F.col("text") == F.col("first.text")) & (F.col("doc_id") > F.col("first.doc_id"))).select("doc_id", "text", "part")
        found = same if found is None else found.unionByName(same)
        texts = materialize(met.where(F.col("text") != F.col("first.text")).select("doc_id", "text", "part", "class", "shares"), f"collided-{rounds}")
        if texts.isEmpty():
            return found
        rounds += 1


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode()
    words = raw.split()  # of bytes: at x20 and x09 to x0D
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    special = len(raw) - len(raw.translate(None, FORBIDDEN))
    return (len(words) < LEAST_WORDS) + 2 * (100 * len(set(words)) < DISTINCT * len(words)) + 4 * (100 * capitals > CAPITALS * len(text)) + 8 * (special > 0)


def with_mask(rows: DataFrame) -> DataFrame:
    """The given columns, of which text is replaced by mask."""
    at = rows.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != "text" else "mask int" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = pa.array([text_mask(t.as_py()) for t in batch.column(at)], pa.int32())
            yield pa.RecordBatch.from_arrays([masks if i == at else c for i, c in enumerate(batch.columns)], names=[n if n != "text" else "mask" for n in batch.schema.names])

    return rows.mapInArrow(run, schema)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part that fail just the filters of mask, and the labelled ones among them."""
    hashes = [f"h{k}" for k in range(BLOCKS)]
    signed = materialize(with_mask(with_blocks(docs).select("doc_id", "text", "part", "n_chars", *hashes)), "signed")
    n_rows = signed.count()
    classes = materialize(repeated_classes(signed, n_rows), "repeated")
    copies = materialize(with_mask(later_copies(docs, classes, n_rows)), "copies")
    failed = F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("mask")
    rows = signed.select("doc_id", "part", "mask", F.lit(1).alias("n"))
    rows = rows.unionByName(copies.select("doc_id", "part", failed, F.lit(1).alias("n"))).unionByName(copies.select("doc_id", "part", "mask", F.lit(-1).alias("n")))
    by_id = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n")).where("n > 0")
    says = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    counted = lambda c: F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c)
    return by_id.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), counted("good"), counted("toxic"))


def audit(masked: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts, a row for every part, order of the filters and step.

    masked: part, mask, n, good, toxic.  A filter's removals over all orders (shapley): among the k filters
    that a document fails, each comes first in one of k orders."""
    every = range(1 << len(filters))
    by_mask = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in every]).alias(c)
    parts = masked.groupBy("part").agg(by_mask("n"), by_mask("good"), by_mask("toxic"))
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(filters)]))
    steps = parts.withColumn("filter_order", orders).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bits = lambda text: sum((F.when(F.instr(text, f) > 0, 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    steps = steps.withColumn("before", bits(F.expr("substring(filter_order, 1, step - 1)"))).withColumn("here", bits(F.expr("substring(filter_order, step, 1)")))

    def total(of: str, which, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(every) - 1)), F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(which(m), F.get(of, m) * weight(m)).otherwise(0))

    fails = lambda m: m.bitwiseAND(F.col("here")) != 0
    earlier = lambda m: m.bitwiseAND(F.col("before")) != 0
    removed = lambda m: fails(m) & ~earlier(m)
    in_orders = lambda m: F.expr(f"{math.factorial(len(filters))}L") / F.bit_count(m)
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda m: ~fails(m) & ~earlier(m)).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & earlier(m)).alias("redundant"),
        total("n", lambda m: m == F.col("here")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("n", fails, lambda m: in_orders(m).cast("long")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(masks(docs, labels))
