"""Document fingerprints from closed syncmers.

A k-mer is CHARS characters, its inner substrings have INNER characters; one begins at every position.  A k-mer is
chosen if its minimal inner substring (by hash) lies at either edge: a choice that depends on the k-mer alone, so equal
passages choose equal anchors whatever surrounds them.  Anchors have positions; the fingerprint string holds all of
them by position, each as 8 hexadecimal digits of its position and 16 of its hash.  Likeness matches positions: the
n-th of the anchors with one hash in one text with the n-th in the other, and is the share of matches among all
anchors of both, a match counting once.

Only DataFrame functions are used.  A text becomes binary, four bytes a character, so that a substring is taken in constant
time; BLOCK positions are a row, whose inner hashes and minima are plain columns in compiled code; each task puts the
blocks of its texts together again.  anchors, matches and likeness are the same for texts at hand.

Defined results: a null text counts as empty and has the empty fingerprint; two empty fingerprints have likeness
1, an empty and another 0; with fewer than CHARS characters the whole text is the one anchor;
without a chosen k-mer the one with the smallest hash is it; rows with equal doc_id
and text are one document that is returned as often as it came; a null doc_id sorts first; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import let, materialize, shuffle_partitions

#: Characters of a k-mer and of its inner substrings; CHARS - INNER + 1 is a power of two.
CHARS, INNER = 24, 9
WINDOW = CHARS - INNER + 1
#: Positions of a text that are a row; a text with SURE characters has a chosen k-mer; partitions of texts for each of shuffles.
BLOCK, SURE, SPREAD = 8, CHARS + WINDOW, 4
#: Positions that anchors works on at a time, and the seed of Spark's hash.
PIECE, SEED = 100_000, 42
_NULL_ID = -(2**63)
#: Digits of an anchor: those of its position and of its hash.
_PLACE, _HASH = 8, 16
Anchors = tuple[np.ndarray, np.ndarray]


def _hashes(codes: np.ndarray, at: np.ndarray | None, chars: int) -> np.ndarray:
    """A hash (its highest bit is set) of chars characters from each place on, or from every place where they fit."""
    data = codes.astype(">u4").tobytes()
    places = range(len(codes) - chars + 1) if at is None else at.tolist()
    return np.array([xxhash.xxh64_intdigest(data[4 * p : 4 * (p + chars)], SEED) | 1 << 63 for p in places], np.uint64)


def closed(inner: np.ndarray) -> np.ndarray:
    """Which windows of WINDOW inner hashes have their minimum at either edge."""
    if len(inner) < WINDOW:
        return np.zeros(0, bool)
    least, width = inner, 1
    while width < WINDOW:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    return (least == inner[: len(least)]) | (least == inner[WINDOW - 1 :])


def anchors(texts: list[str]) -> list[Anchors]:
    """The anchors of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes)
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for begin in range(0, len(codes), PIECE):
        piece = codes[begin : begin + PIECE + CHARS - 1]
        at = np.flatnonzero(closed(_hashes(piece, None, INNER)))
        at = at[begin + at + CHARS <= ends[np.searchsorted(ends, begin + at, "right")]]
        places.append(begin + at)
        hashes.append(_hashes(piece, at, CHARS))
    place, hash_ = np.concatenate(places), np.concatenate(hashes)
    out = []
    for text, end, lo, hi in zip(texts, ends.tolist(), np.searchsorted(place, ends - sizes).tolist(), np.searchsorted(place, ends).tolist(), strict=True):
        found = place[lo:hi] - (end - len(text)), hash_[lo:hi]
        out.append(found if hi > lo or not text else _other(text, codes[end - len(text) : end]))
    return out


def _other(text: str, codes: np.ndarray) -> Anchors:
    """The one anchor that stands for a text without a chosen k-mer: a text of a few dozen characters at most."""
    each = _hashes(codes, None, min(CHARS, len(text)))
    at = int(each.argmin())
    return np.array([at]), each[at : at + 1]


def matches(a: Anchors, b: Anchors) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a and in b of the anchors that match: the n-th with a hash with the n-th."""
    if not len(a[0]) or not len(b[0]):
        return a[0][:0], b[0][:0]
    by_a, by_b = (np.argsort(x[1], kind="stable") for x in (a, b))
    hash_a, hash_b = a[1][by_a], b[1][by_b]
    number = np.arange(len(hash_a)) - np.searchsorted(hash_a, hash_a)
    to = np.searchsorted(hash_b, hash_a) + number
    ok = to < len(hash_b)
    ok[ok] = hash_b[to[ok]] == hash_a[ok]
    return a[0][by_a[ok]], b[0][by_b[to[ok]]]


def likeness(a: Anchors, b: Anchors) -> float:
    """Share of matches among all anchors of both."""
    both = len(a[0]) + len(b[0])
    n = len(matches(a, b)[0])
    return n / (both - n) if both else 1.0


def hash_at(data: Column, at: Column, chars: int | Column) -> Column:
    """A hash of chars characters of data, four bytes each, from a byte on (from 1).  Its highest bit is set, so it has 16 digits
    and its order is the same with and without a sign."""
    size = F.lit(4 * chars) if isinstance(chars, int) else 4 * chars
    return F.xxhash64(F.substring(data, at, size)).bitwiseOR(F.lit(-(2**63)))


def _digits(place: Column, hash_: Column) -> Column:
    return F.concat(F.lpad(F.hex(place), _PLACE, "0"), F.hex(hash_))


def _spare(data: Column, n: Column) -> Column:
    """The anchor of a text of n characters that has no chosen k-mer."""
    chars = F.least(n, F.lit(CHARS)).cast("int")
    each = F.transform(F.sequence(F.lit(0), (n - chars).cast("int")), lambda i: F.struct(hash_at(data, 4 * i + 1, chars).alias("hash"), i.alias("place")))
    return F.when((n > 0) & (n < SURE), let(F.array_min(each), lambda x: _digits(x["place"].cast("long"), x["hash"])))


def _blocks(n: Column) -> Column:
    """Blocks of a text of n characters."""
    return F.ceil(F.greatest(n - (CHARS - 1), F.lit(0)) / BLOCK).cast("int")


def chosen(rows: DataFrame, kept: list[str]) -> DataFrame:
    """The kept columns of rows(data, at, left, place) with place and digits: the anchors of the BLOCK k-mers from the byte at on,
    where left characters are left of the text, as if the first had that place."""
    inner = [hash_at(F.col("data"), F.col("at") + 4 * k, INNER) for k in range(BLOCK + WINDOW - 1)]
    least, width = inner, 1
    while width < WINDOW:
        least, width = [F.least(a, b) for a, b in zip(least, least[width:], strict=False)], 2 * width
    # one select of nested columns, so that each shared one is a method of its own in the code that Spark makes: a longer one isn't compiled
    layer = rows.select(*kept, "data", "at", "left", "place", *[(a == F.least(inner[k], inner[k + WINDOW - 1])).alias(f"c{k}") for k, a in enumerate(least)])
    each = [F.when(F.col(f"c{k}") & (F.col("left") >= k + CHARS), _digits(F.col("place") + k, hash_at(F.col("data"), F.col("at") + 4 * k, CHARS))) for k in range(BLOCK)]
    return layer.select(*kept, "place", F.concat_ws("", *each).alias("digits"))


def _joined(side: str) -> Column:
    """The digits of a side's blocks in order."""
    return F.lower(F.array_join(F.sort_array(side).getField("digits"), ""))


def _ending_by(digits: str, size: Column, end: Column) -> Column:
    """The anchors of digits that end by a place, of a text of size characters before it."""
    last = F.lower(F.lpad(F.hex(end - CHARS), _PLACE, "0"))
    n = F.size(F.filter(F.regexp_extract_all(digits, F.lit(f"(.{{{_PLACE}}}).{{{_HASH}}}"), 1), lambda x: x <= last))
    return F.when(size >= CHARS, F.substring(digits, F.lit(1), n * (_PLACE + _HASH))).otherwise("")


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, anchors (array of position and hash), fingerprint of each document."""
    found = _compared(_by_text(_rows(docs), "text").withColumn("next", F.lit("")))
    anchors = F.transform(F.regexp_extract_all("fingerprint", F.lit(f"(.{{{_PLACE + _HASH}}})"), 1), lambda x: F.struct(F.conv(F.substring(x, 1, _PLACE), 16, 10).cast("int").alias("position"), F.conv(F.substring(x, _PLACE + 1, _HASH), 16, -10).cast("long").alias("hash")))
    return found.select("doc_id", "n_chars", anchors.alias("anchors"), "fingerprint")


def successors(keys: DataFrame, partitions: int) -> DataFrame:
    """id, text_hash, before: of each document of keys, the key and length of the document before it in
    ascending order (before the first: the last).  Only ids, hashes and lengths are sorted."""
    ranged = materialize(keys.repartitionByRange(partitions, "id", "text_hash").withColumn("part", F.spark_partition_id()), "fingerprint-keys")
    entry = F.struct("id", "text_hash", "n_chars")
    within = ranged.withColumn("before", F.lag(entry).over(Window.partitionBy("part").orderBy("id", "text_hash")))
    ends = ranged.groupBy("part").agg(F.max(entry).alias("last"))  # a row for each partition
    ends = ends.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.max("last").over(Window.partitionBy(F.lit(0)))).alias("last_before"))
    joined = within.join(F.broadcast(ends), "part", "left")
    return joined.select("id", "text_hash", F.coalesce("before", "last_before").alias("before"))


def _hashes_of(digits: Column) -> Column:
    return F.regexp_extract_all(digits, F.lit(f".{{{_PLACE}}}(.{{{_HASH}}})"), 1)


def _numbered(hashes: str) -> Column:
    """Hashes, of which equal ones are told apart by their number."""

    def runs(x: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (x[i] != x[F.greatest(i - 1, F.lit(0))]))
        return let(first, lambda at: F.flatten(F.transform(at, lambda i, k: F.transform(F.sequence(F.lit(1), F.coalesce(F.get(at, k + 1), F.size(x)) - i), lambda n: F.concat(x[i], n.cast("string"))))))

    return F.when(F.size(hashes) > 0, let(F.sort_array(hashes), runs)).otherwise(F.array().cast("array<string>"))


def _likeness(a: str, b: str) -> Column:
    """Matches are counted by number only if hashes of a are repeated: else each hash of a matches once at most."""
    n = F.when(F.col("repeated"), F.size(F.array_intersect(_numbered(a), _numbered(b)))).otherwise(F.size(F.array_intersect(a, b)))
    both = F.size(a) + F.size(b)
    return let(n, lambda n: F.when(both == 0, 1.0).otherwise(n / F.greatest(both - n, F.lit(1))))


def _by_text(rows: DataFrame, *firsts: str) -> DataFrame:
    """id, text_hash, copies and the first columns of each document of rows, dealt to SPREAD times the usual partitions."""
    parts = SPREAD * shuffle_partitions(rows.sparkSession)
    return rows.repartition(parts, "id", "text_hash").groupBy("id", "text_hash").agg(*[F.first(c).alias(c) for c in firsts], F.count(F.lit(1)).alias("copies"))


def _compared(met: DataFrame) -> DataFrame:
    """What edited_fingerprints returns, of one row of id, text_hash, copies, text and next (the next document's text) for each
    document, dealt by id and text_hash.  The edited text's anchors are those of both parts and of the edge between them."""
    wide = CHARS - 1
    sized = met.select("id", "text_hash", "copies", "text", "next", F.encode("text", "UTF-32").alias("own"), F.encode("next", "UTF-32").alias("after"), F.length("text").cast("long").alias("n"), F.length("next").cast("long").alias("n_next"))
    sized = sized.withColumn("keep", F.col("n") - F.expr("n div 2")).withColumn("taken", F.least(F.col("n") - F.col("keep"), "n_next")).withColumn("edge_at", F.greatest(F.col("keep") - wide, F.lit(0)))
    piece = lambda data, at, size: F.substring(data, (4 * at + 1).cast("int"), (4 * size).cast("int"))
    zero = F.lit(0)
    edited = F.concat(piece("own", zero, F.col("keep")), piece("after", zero, F.col("taken")))
    head = F.struct(
        "copies", "n", "keep", "taken", F.sha2(F.concat(F.substring("text", F.lit(1), F.col("keep").cast("int")), F.substring("next", F.lit(1), F.col("taken").cast("int"))).cast("binary"), 256).alias("edited_sha256"),
        _spare(F.col("own"), F.col("n")).alias("spare_own"), F.when(F.col("keep") + F.col("taken") < SURE, _spare(edited, F.col("keep") + F.col("taken"))).alias("spare_edited"), _spare(F.col("after"), F.col("n_next")).alias("spare_next"),
    )
    near_edge = F.least("taken", F.lit(wide))
    edge = F.concat(piece("own", F.col("edge_at"), F.col("keep") - F.col("edge_at")), piece("after", zero, near_edge))
    known = sized.select("id", "text_hash", head.alias("head"), "own", "after", edge.alias("edge"), "n", "n_next", (F.col("keep") - F.col("edge_at") + near_edge).alias("n_edge"), "keep", "taken", "edge_at")
    known = known.withColumns({"b_own": _blocks(F.col("n")), "b_edge": _blocks(F.col("n_edge")), "b_next": _blocks(F.col("n_next"))})
    rows = known.select("*", F.explode(F.sequence(F.lit(0), F.col("b_own") + F.col("b_edge") + F.col("b_next"))).alias("i"))
    at = F.col("i") - 1  # row 0 stands for the document itself
    side = F.when(F.col("i") == 0, -1).when(at < F.col("b_own"), 0).when(at < F.col("b_own") + F.col("b_edge"), 1).otherwise(2)
    rows = rows.withColumn("side", side)
    of = lambda own, edge, after: F.when(F.col("side") == 0, own).when(F.col("side") == 1, edge).when(F.col("side") == 2, after)
    begin = (at - of(zero, F.col("b_own"), F.col("b_own") + F.col("b_edge"))) * BLOCK
    rows = rows.select(
        "id", "text_hash", F.when(F.col("i") == 0, F.col("head")).alias("head"), "side", F.coalesce(of(F.col("own"), F.col("edge"), F.col("after")), F.lit("").cast("binary")).alias("data"), F.coalesce(4 * begin + 1, F.lit(1)).alias("at"),
        F.coalesce((of(F.col("n"), F.col("n_edge"), F.col("n_next")) - begin).cast("int"), F.lit(0)).alias("left"), F.coalesce(begin + of(zero, F.col("edge_at"), F.col("keep")), F.lit(0).cast("long")).alias("place"),
    )
    found = chosen(rows, ["id", "text_hash", "head", "side"])
    of_side = lambda k: F.collect_list(F.when((F.col("side") == k) & (F.col("digits") != ""), F.struct("place", "digits")))
    whole = found.groupBy("id", "text_hash").agg(F.first("head", ignorenulls=True).alias("head"), of_side(0).alias("own"), of_side(1).alias("edge"), of_side(2).alias("after"))
    strings = whole.select("id", "head", _joined("own").alias("own"), _joined("edge").alias("edge"), _joined("after").alias("after"))
    kept, all_of = F.col("head.keep"), F.col("head.keep") + F.col("head.taken")
    or_spare = lambda c, spare: F.coalesce(F.nullif(c, F.lit("")), F.lower(f"head.{spare}"), F.lit(""))
    cut = strings.select("*", _ending_by("own", kept, kept).alias("from_own"), _ending_by("after", F.col("head.taken"), all_of).alias("from_after"))
    edited_digits = F.concat("from_own", "edge", "from_after")
    prints = cut.select("id", "head", "edge", or_spare(F.col("own"), "spare_own").alias("fingerprint"), or_spare(edited_digits, "spare_edited").alias("edited_fingerprint"), or_spare(F.col("after"), "spare_next").alias("next_fingerprint"), *[F.expr(f"length({c}) div {_PLACE + _HASH}").cast("int").alias(f"n_{c}") for c in ("from_own", "from_after")])
    hashes = prints.select("*", *[_hashes_of(F.col(c)).alias(f"in_{c}") for c in ("fingerprint", "next_fingerprint", "edge")])
    parts = F.concat(F.slice("in_fingerprint", F.lit(1), F.col("n_from_own")), F.col("in_edge"), F.slice("in_next_fingerprint", F.lit(1), F.col("n_from_after")))
    hashes = hashes.select("*", (F.size(F.array_distinct("in_fingerprint")) < F.size("in_fingerprint")).alias("repeated"), F.when((F.col("n_from_own") + F.col("n_from_after") > 0) | (F.col("edge") != ""), parts).otherwise(_hashes_of(F.col("edited_fingerprint"))).alias("in_edited_fingerprint"))
    likeness_to = lambda c: _likeness("in_fingerprint", f"in_{c}")
    out = hashes.select("id", "head", "fingerprint", "edited_fingerprint", likeness_to("edited_fingerprint").alias("near_edited"), likeness_to("next_fingerprint").alias("near_next"))
    copies = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("head.copies"))))
    return copies.select(F.nullif("id", F.lit(_NULL_ID)).alias("doc_id"), F.col("head.n").alias("n_chars"), "head.edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (its second half replaced by the beginning of the next
    document), and how alike they are."""
    rows = _rows(docs)
    keys = rows.groupBy("id", "text_hash").agg(F.max(F.length("text")).cast("long").alias("n_chars"))
    order = successors(keys, shuffle_partitions(docs.sparkSession))
    texts = _by_text(rows, "text")  # one shuffle of the texts; both sides below read it
    given = texts.join(order, ["id", "text_hash"]).select(F.col("before.id").alias("id"), F.col("before.text_hash").alias("text_hash"), F.col("text").alias("next"))
    given = given.repartition(SPREAD * shuffle_partitions(docs.sparkSession), "id", "text_hash")
    return _compared(texts.join(given, ["id", "text_hash"]))  # anchors are made after the shuffle: they are larger than texts
