"""Fuzzy line deduplication by MinHash.

Each distinct line gets MinHash values of its character shingles, bands of them make buckets, members of a
bucket are verified by the exact Jaccard similarity of all their character shingles, and a distributed union-find
joins what is linked.  Of each component one occurrence stays: the first by doc_id, text hash and line number.

A shingle is SHINGLE characters; one begins at every position of a line, for signatures and for verification.  Both
are made by numpy in Arrow batches; the form with DataFrame functions only takes twice the CPU seconds (README).

Buckets never give all pairs: first each member is verified against two leaders of its bucket, which differ from bucket to
bucket; only buckets whose other members then still are of several components are looked at again, in bounded blocks that
are dealt to tasks each on its own, and only pairs between components that pass a bound on their difference leave them.

Defined results: lines without a visible character always stay; lines shorter than a shingle are linked only with
their exact copies; a null text stays null and has no lines; rows with equal doc_id and text are one document that
comes back as often as it came; a null doc_id sorts first; an empty table gives no rows; other columns stay as they
are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import FILTER_WORDS, known_words, let, materialize
from .components import components
from .ngram_join import finish, in_blocks, mixed_members, parity, similar
from .shingles import mix

SHINGLE = 5
#: Ten bands of four find 99.5 % of pairs at SIMILARITY and 99.98 % of those at 0.9.
BANDS, ROWS = 10, 4
#: In hundredths.
SIMILARITY = 80
#: Two bits of each of the first SKETCHED MinHash values make a sketch; sketches agree if AGREEING of them do, which a
#: pair at SIMILARITY fails with a chance of 4 in 10,000 and one at 0.9 of less than 1 in 10 million.
SKETCHED, AGREEING = 32, 20
#: Bytes of a line's parity sketch; characters that are hashed at a time; lines that a task remembers; rows of a batch
#: that leaves Python.
PARITY, PIECE, SEEN, ROWS_OUT = 256, 50_000, 500_000, 200_000
#: The white space without which a line must have a character.
_BLANK = " \t\x0b\f\r"
_NULL_ID = -(2**63)


def _constants(n: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_MULTIPLIERS = _constants(SHINGLE)
_FACTORS, _MASKS = ((_constants(BANDS * ROWS) >> np.uint64(n)).astype(np.uint32) | np.uint32(1) for n in (8, 32))


def _hash(line: str) -> int:
    code = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return code - 2**64 if code >= 2**63 else code


def seen_lines(text: str | None) -> Iterator[tuple[int, str]]:
    """Number and line of every line with a visible character."""
    return ((i, line) for i, line in enumerate(text.split("\n")) if line.strip(_BLANK)) if text else iter(())


def line_places(docs: DataFrame) -> DataFrame:
    """id, text_hash, line_no, line_hash of every line with a visible character."""
    kinds = {"id": pa.int64(), "text_hash": pa.int64(), "line_no": pa.int32(), "line_hash": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for of, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for i, line in seen_lines(text.as_py()):
                    for column, value in zip(out, (of, text_hash, i, _hash(line)), strict=True):
                        column.append(value)
                if len(out[0]) >= ROWS_OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds.values(), strict=True)], names=list(kinds))
                    out = ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds.values(), strict=True)], names=list(kinds))

    rows = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "id long, text_hash long, line_no int, line_hash long")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text of the wanted lines (node), one row each.  A filter of bounded size spares most others the way."""
    words = np.zeros(FILTER_WORDS, np.int64)
    for r in known_words(wanted, "node").toLocalIterator():
        words[r["_word"]] = r["_bits"]
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            found: dict[int, str] = {}
            for text in batch.column(0):
                for _, line in seen_lines(text.as_py()):
                    if (code := _hash(line)) not in seen:
                        found[code] = line
            codes = np.fromiter(found, np.int64, len(found))
            near = shared.value[codes % FILTER_WORDS] >> (codes.view(np.uint64) >> np.uint64(58)).astype(np.int64) & 1
            chosen = pa.array(near.astype(bool))
            seen.update(found)
            if len(seen) > SEEN:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(codes).filter(chosen), pa.array(list(found.values()), pa.string()).filter(chosen)], names=["node", "text"])

    maybe = docs.where("text is not null").select("text").mapInArrow(run, "node long, text string")
    return maybe.join(wanted, "node").groupBy("node").agg(F.first("text").alias("text"))


def characters(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lines one after the other, and where each line ends."""
    return np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([len(x) for x in found])


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the SHINGLE characters from each position on."""
    n = len(codes) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += codes[k : k + n] * _MULTIPLIERS[k]
    return mix(out)


def minima(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MinHash values of lines of SHINGLE characters or more, a row for each function: PIECE positions at a time, so
    that a line may have any length."""
    begins = np.append(0, ends[:-1])
    out = np.full((BANDS * ROWS, len(ends)), 2**32 - 1, np.uint32)
    for at in range(0, len(codes) - SHINGLE + 1, PIECE):
        hashes = shingle_hashes(codes[at : at + PIECE + SHINGLE - 1])
        lo, hi = np.searchsorted(ends, at, "right"), np.searchsorted(begins, at + len(hashes))
        edges = np.stack([np.clip(begins[lo:hi] - at, 0, None), np.minimum(ends[lo:hi] - SHINGLE + 1 - at, len(hashes))], axis=1)
        some = np.flatnonzero(edges[:, 0] < edges[:, 1])
        if not len(some):
            continue
        flat = edges[some].ravel()
        padded = np.append(hashes, np.uint64(0))  # an end may lie behind the last hash
        for half in range(2):
            short = (padded >> np.uint64(32 * half)).astype(np.uint32)
            for k in range(half, BANDS * ROWS, 2):
                least = np.minimum.reduceat((short ^ _MASKS[k]) * _FACTORS[k], flat)[::2]
                out[k, lo + some] = np.minimum(out[k, lo + some], least)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """line_hash, bits and the band keys k0.. of each distinct line of SHINGLE characters or more; bits: two of each of the
    first SKETCHED MinHash values."""
    names = ["line_hash", "bits", *[f"k{b}" for b in range(BANDS)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[str] = []
        hashes: list[int] = []

        def rows() -> pa.RecordBatch:
            least = minima(*characters(held))
            bits = np.zeros(len(held), np.uint64)
            for k in range(SKETCHED):
                bits |= (least[k] & np.uint32(3)).astype(np.uint64) << np.uint64(2 * k)
            keys = []
            for b in range(BANDS):
                key = np.full(len(held), b + 1, np.uint64)
                for r in range(ROWS):
                    key = mix(key + least[b * ROWS + r])
                keys.append(key)
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (np.array(hashes, np.int64), *(x.view(np.int64) for x in (bits, *keys)))], names=names)
            held.clear()
            hashes.clear()
            return out

        for batch in batches:
            size = 0
            for text in batch.column(0):
                for _, line in seen_lines(text.as_py()):
                    if len(line) >= SHINGLE and (code := _hash(line)) not in seen:
                        seen.add(code)
                        held.append(line)
                        hashes.append(code)
                        size += len(line)
                        if size >= 20 * PIECE:
                            yield rows()
                            size = 0
            if held:
                yield rows()
            if len(seen) > SEEN:
                seen.clear()

    each = docs.select("text").where("text is not null").mapInArrow(run, ", ".join(f"{c} long" for c in names))
    return each.groupBy("line_hash").agg(*[F.first(c).alias(c) for c in names[1:]])


def agree(a: Column, b: Column) -> Column:
    """Whether AGREEING or more of the values behind two sketches agree."""
    bits = a.bitwiseXOR(b)
    return F.bit_count(bits.bitwiseOR(F.shiftright(bits, 1)).bitwiseAND(F.lit(0x5555555555555555))) <= SKETCHED - AGREEING


def buckets(signed: DataFrame) -> DataFrame:
    """bucket, n, line_hash, bits, leads, near of each member of a bucket with n > 1 lines: whether it is a leader, and the
    leaders whose sketches agree with its own.  A bucket's leaders are the members with the least and the largest hash of line and bucket."""
    rows = signed.select("line_hash", "bits", F.explode(F.array(*[f"k{b}" for b in range(BANDS)])).alias("bucket")).repartition("bucket")
    place = F.xxhash64("line_hash", "bucket")
    ends = {"first": F.min_by, "last": F.max_by}
    heads = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[by(c, place).alias(f"{end}_{c}") for end, by in ends.items() for c in ("line_hash", "bits")]).where("n > 1")
    near = [F.when((F.col(f"{end}_line_hash") != F.col("line_hash")) & agree(F.col(f"{end}_bits"), F.col("bits")), F.col(f"{end}_line_hash")) for end in ends]
    leads = F.col("line_hash").isin(F.col("first_line_hash"), F.col("last_line_hash"))
    return rows.join(heads, "bucket").select("bucket", "n", "line_hash", "bits", leads.alias("leads"), F.array_compact(F.array(*near)).alias("near"))


def sets_of_lines(found: list[str]) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each line of SHINGLE characters or more."""
    codes, ends = characters(found)
    hashes = shingle_hashes(codes)
    sets = []
    for begin, end in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        own = np.sort(hashes[begin : end - SHINGLE + 1])
        sets.append(own[np.append(True, own[1:] != own[:-1])])
    return sets


def line_sketches(texts: DataFrame) -> DataFrame:
    """node, n_shingles, parity of each of texts(node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = sets_of_lines(batch.column(1).to_pylist())
            sizes = np.array([len(x) for x in sets], np.int64)
            sketches = parity(np.concatenate(sets), np.cumsum(sizes), PARITY)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array([x.tobytes() for x in sketches], pa.binary())], names=["node", "n_shingles", "parity"])

    return texts.select("node", "text").mapInArrow(run, "node long, n_shingles long, parity binary")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a few hundred lines, so that their sets take little room."""
    return (whole.slice(i, 200) for whole in batches for i in range(0, whole.num_rows, 200))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines reach SIMILARITY, by all their shingles; texts: node, text.  Lines are shuffled, not their larger sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ok = [similar(x, y) for x, y in zip(*(sets_of_lines(batch.column(k).to_pylist()) for k in (2, 3)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"of_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def with_partner(members: DataFrame) -> DataFrame:
    """node of each of members(entry, node, component, bits) whose sketch agrees with that of a member of another
    component: as many rows as members at most."""

    def run(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, same, first, node, component, bits = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k in range(6))
        chosen = np.zeros(len(group), bool)
        bits = bits.view(np.uint64)
        k = 1
        while k < len(group):
            at = np.flatnonzero(group[k:] == group[:-k])
            if not len(at):
                break
            to = at + k
            ok = (component[at] != component[to]) & (same[at] | (first[at] != first[to]))
            at, to = at[ok], to[ok]
            differ = bits[at] ^ bits[to]
            ok = np.bitwise_count((differ | differ >> np.uint64(1)) & np.uint64(0x5555555555555555)) <= SKETCHED - AGREEING
            chosen[at[ok]] = chosen[to[ok]] = True
            k += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[chosen]), pa.int64())], names=["node"])

    return in_blocks(members, ["bits"], run, "node long").distinct()


def fuzzy_components(docs: DataFrame) -> DataFrame:
    """node (a line_hash), component of every line that is linked with a line of another text."""
    met = materialize(buckets(signatures(docs)), "line-buckets")
    star = met.select("line_hash", F.explode("near").alias("leader"))
    star = materialize(star.select(F.least("leader", "line_hash").alias("a"), F.greatest("leader", "line_hash").alias("b")).distinct(), "line-pairs")
    texts = materialize(texts_of(docs, star.select(F.explode(F.array("a", "b")).alias("node")).distinct()), "line-texts")
    first = components(materialize(verified(star, texts), "line-links"))
    # leaders have met all, and the one other member of three has met both
    rest = met.where("not leads and n > 3").select(F.col("bucket").alias("entry"), F.col("line_hash").alias("node"), "bits")
    members = mixed_members(rest, first)
    wanted = materialize(with_partner(members), "line-rest")
    texts = materialize(texts_of(docs, wanted), "line-texts")
    sketches = materialize(line_sketches(texts), "line-sketches")
    return finish(members.join(wanted, "node").select("entry", "node"), first, sketches, star, lambda pairs: materialize(verified(pairs, texts), "line-links"))


def kept_lines(docs: DataFrame) -> DataFrame:
    """id, text_hash, kept: the numbers of the lines with a visible character that stay.  The first place of each line
    is found before components are, so nothing is dealt by the component of a line that is everywhere."""
    place = F.struct("id", "text_hash", "line_no")
    first = line_places(docs).groupBy("line_hash").agg(F.min(place).alias("place"))
    group = fuzzy_components(docs).withColumnRenamed("node", "line_hash")
    placed = first.join(group, "line_hash", "left").groupBy(F.coalesce("component", "line_hash").alias("component")).agg(F.min("place").alias("place"))
    return placed.groupBy("place.id", "place.text_hash").agg(F.collect_list("place.line_no").alias("kept"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text cut to the lines that stay, and n_lines and n_removed (columns of these names are replaced)."""
    found = kept_lines(docs).select(F.col("id").alias("_line_id"), F.col("text_hash").alias("_line_text"), F.col("kept").alias("_line_kept"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.withColumns({"_line_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)), "_line_hash": F.xxhash64("text")})
    joined = keyed.join(found, (F.col("_line_key") == F.col("_line_id")) & (F.col("_line_hash") == F.col("_line_text")), "left")

    def cut(every: Column) -> Column:
        """The text of the lines that stay and their number; each line is looked at once, however many there are."""
        unseen = F.filter(F.sequence(F.lit(0), F.size(every) - 1), lambda i: ~every[i].rlike(r"\S"))
        staying = F.array_sort(F.concat(unseen, F.coalesce("_line_kept", F.array().cast("array<int>"))))
        text = let(staying, lambda at: F.when(F.size(at) < F.size(every), F.array_join(F.transform(at, lambda i: every[i]), "\n")).otherwise(F.col("text")))
        return F.struct(text.alias("text"), F.size(every).alias("n_lines"), (F.size(every) - F.size(unseen) - F.coalesce(F.size("_line_kept"), F.lit(0))).alias("n_removed"))

    done = joined.withColumn("_line_cut", F.when(F.col("text").isNotNull(), let(F.split("text", "\n"), cut)))
    number = lambda c: F.coalesce(F.col(f"_line_cut.{c}"), F.lit(0)).cast("long").alias(c)
    return done.select(*[F.col("_line_cut.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], number("n_lines"), number("n_removed"))
