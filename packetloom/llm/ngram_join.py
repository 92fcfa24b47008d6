"""Exact Jaccard self-join of documents on word shingles, by token-combination prefixes.

Tokens (shingles) are in one global order: those of one document first, then rare ones, then frequent ones by their
number of documents.  A pair of similarity t shares its smallest common token within both prefixes of
n - ceil(t n) + 1 tokens.  If that token is rare, it is an index entry on its own.  If it is frequent, so are all common tokens; prefixes that
are longer by c tokens then share c + 1 of them, so with frequent tokens dealt into c classes two of one class are
common: such pairs of tokens are the index entries of the frequent classes.  c grows with the length of a set,
which keeps the entries of a set in proportion to its length; sets enter under their own and the next smaller length class, as
partners are at most one class apart.

Which tokens count as frequent never decides a result, only its cost: a table of at most MAX_FREQUENT tokens
travels to the executors.

Entries never give all pairs of a group.  First each set meets the smallest member of its entries; what
is linked becomes a component; only entries that then hold several components are looked at again, in blocks, and only
pairs between components that pass a bound on their difference leave them, at first of each set the closest one.  Equal sets are one node from the start.

Defined results: a null text or one without words has an empty set and is linked with nothing; with fewer words
than a shingle the whole sequence is the one shingle; repeated rows are nodes of their text; a null doc_id takes part
but is never a component's id unless all are null; an empty table gives no rows; columns other than doc_id
and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import known_words, materialize, maybe_known, shuffle_partitions
from .components import components
from .shingles import mix, set_hash, sets_of, slices

#: Similarity in hundredths.
SIMILARITY = 80
#: A token of this many sets may be frequent; entries of the table of frequent tokens at most.
FREQUENT, MAX_FREQUENT = 32, 1_000_000
#: A class of frequent tokens for so many tokens of a set.
CLASS_TOKENS = 8
#: Bits of a token by which sets are counted, and of the slices into which they are dealt.
COUNT_BITS, SLICE_BITS = 42, 10
#: Bits of the filter of repeated tokens.  Tokens of one document alone are no index entries; a full filter only saves less.
REPEATED_BITS = 28
#: Tokens that a task holds before it hands its counts on; bytes of a set's parity sketch; nodes that a task remembers.
HELD, PARITY, SEEN = 2_000_000, 512, 500_000
#: Rounds in which a component meets the most similar set of a block only; how many there are never decides a result.
CLOSEST_ROUNDS = 2
#: Places whose closest members lead an entry: the first few at once, the others where components then still meet.
PLACES, FIRST_LEADERS = [((i * 0x9E3779B97F4A7C15) % 2**64) - 2**63 for i in range(1, 13)], 4
#: Rows of a batch that leaves Python; sets of a block when the rest of an entry is compared.
OUT, BLOCK = 200_000, 1_000


def _batches(rows: dict[str, tuple[np.ndarray, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(rows.values()))[0])
    for i in range(0, n, OUT):
        yield pa.RecordBatch.from_arrays([pa.array(v[i : i + OUT], k) for v, k in rows.values()], names=list(rows))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def parity(tokens: np.ndarray, ends: np.ndarray, size: int = PARITY) -> np.ndarray:
    """A sketch of size bytes for each set: which of its bits odd numbers of tokens fall on.  Two sets that differ
    in d tokens differ in at most d bits."""
    out, begins, bits = [], np.append(0, ends[:-1]).astype(np.int64), size * 8
    for at in range(0, len(ends), 64):  # counts of a few sets stay in the processor's cache
        sizes = ends[at : at + 64] - begins[at : at + 64]
        own = tokens[begins[at] : begins[at] + sizes.sum()]
        place = np.repeat(np.arange(len(sizes)) * bits, sizes) + ((own >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
        odd = (np.bincount(place, minlength=len(sizes) * bits) & 1).astype(np.uint8)
        out.append(np.packbits(odd.reshape(len(sizes), bits), axis=1))
    return np.concatenate(out) if out else np.empty((0, size), np.uint8)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What two sets differ by at least; a, b: their sketches by row, of 8 bytes a column."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the similarity."""
    common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * common >= SIMILARITY * (len(x) + len(y) - common)


def documents_as_sets(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, node (hash of the set, null if empty), parity."""
    schema = "doc_id long, text_hash long, n_shingles long, node long, parity binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, offsets in slices(batch.column(2)):
                tokens, ends = sets_of(data, offsets)
                sizes = np.diff(np.append(0, ends))
                sketches = parity(tokens, ends)
                nodes = pa.array(_signed(set_hash(tokens, ends)), pa.int64(), mask=sizes == 0)
                own = [batch.column(k)[begin:end] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sizes, pa.int64()), nodes, pa.array([x.tobytes() for x in sketches], pa.binary())], names=["doc_id", "text_hash", "n_shingles", "node", "parity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def token_counts(docs: DataFrame, partitions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all documents: the most frequent tokens (their first COUNT_BITS bits, sorted), their counts, and a filter of
    2 ** REPEATED_BITS bits that knows every token of more than one document."""
    low = np.uint64(COUNT_BITS - SLICE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def rows() -> Iterator[pa.RecordBatch]:
            tokens = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            held.clear()
            slice_of = (tokens >> low).astype(np.int64)
            edges = np.append(np.flatnonzero(np.diff(slice_of, prepend=-1)), len(tokens))
            rest = (tokens & np.uint64((1 << int(low)) - 1)).astype(np.uint32)
            if len(tokens):
                yield pa.RecordBatch.from_arrays([pa.array(slice_of[edges[:-1]], pa.int64()), pa.array([rest[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["slice", "tokens"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                held.append(sets_of(data, offsets)[0] >> np.uint64(64 - COUNT_BITS))
                if sum(map(len, held)) > HELD:
                    yield from rows()
        yield from rows()

    def total(_, pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, counts = np.unique(np.frombuffer(b"".join(pdf["tokens"]), np.uint32), return_counts=True)
        often = counts >= FREQUENT
        bits = np.zeros(1 << (REPEATED_BITS - SLICE_BITS), np.uint8)
        bits[_bit_in_slice(tokens[counts > 1])] = 1
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "tokens": [tokens[often].tobytes()], "counts": [counts[often].astype(np.int64).tobytes()], "repeated": [np.packbits(bits).tobytes()]})

    dealt = docs.select("text").mapInArrow(count, "slice long, tokens binary").repartition(partitions, "slice")
    counted = materialize(dealt.groupBy("slice").applyInPandas(lambda k, pdf: total(k, pdf), "slice long, tokens binary, counts binary, repeated binary"), "token-counts")
    powers = counted.select("counts").mapInPandas(_by_power, "power int, n long").groupBy("power").agg(F.sum("n").alias("n")).collect()
    least, room = 63, MAX_FREQUENT
    for r in sorted(powers, key=lambda r: -r["power"]):
        if (room := room - r["n"]) < 0:
            break
        least = r["power"]

    def kept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, t, c in zip(pdf["slice"], pdf["tokens"], pdf["counts"], strict=True):
                counts = np.frombuffer(c, np.int64)
                often = counts >= 1 << least
                whole = (np.uint64(s) << low) | np.frombuffer(t, np.uint32)[often].astype(np.uint64)
                out.append((whole.tobytes(), counts[often].tobytes()))
            yield pd.DataFrame(out, columns=["tokens", "counts"])

    rows = counted.select("slice", "tokens", "counts").mapInPandas(kept, "tokens binary, counts binary").collect()  # at most MAX_FREQUENT tokens
    tokens, counts = (np.frombuffer(b"".join(r[k] for r in rows), t) for k, t in (("tokens", np.uint64), ("counts", np.int64)))
    order = np.argsort(tokens)
    size = 1 << (REPEATED_BITS - SLICE_BITS - 3)
    repeated = np.zeros(size << SLICE_BITS, np.uint8)
    for r in counted.select("slice", "repeated").toLocalIterator():
        repeated[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["repeated"], np.uint8)
    return tokens[order], counts[order], repeated


def _bit_in_slice(tokens: np.ndarray) -> np.ndarray:
    """Bit of a token's low bits in its slice of the filter of repeated tokens."""
    return (tokens.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(32 - (REPEATED_BITS - SLICE_BITS))).astype(np.int64)


def is_repeated(short: np.ndarray, repeated: np.ndarray) -> np.ndarray:
    """Which tokens (their first COUNT_BITS bits) a filter knows."""
    low = COUNT_BITS - SLICE_BITS
    bit = ((short >> np.uint64(low)).astype(np.int64) << (REPEATED_BITS - SLICE_BITS)) + _bit_in_slice(short & np.uint64((1 << low) - 1))
    return (repeated[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


def _by_power(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        counts = np.frombuffer(b"".join(pdf["counts"]), np.int64)
        powers, n = np.unique(np.log2(np.maximum(counts, 1)).astype(np.int32), return_counts=True)
        yield pd.DataFrame({"power": powers, "n": n})


def length_classes(longest: int) -> np.ndarray:
    """First length of each class: partners of similarity 0.8 are in the same class or the next."""
    edges = [1]
    while edges[-1] <= longest:
        edges.append(edges[-1] * 100 // SIMILARITY + 1)
    return np.array(edges, np.int64)


def entries_of(tokens: np.ndarray, ends: np.ndarray, nodes: np.ndarray, known_counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(entries, nodes): index entries of the sets."""
    begins = np.append(0, ends[:-1]).astype(np.int64)
    sizes = ends - begins
    text = np.repeat(np.arange(len(ends)), sizes)
    known, counts, repeated = known_counts
    short = tokens >> np.uint64(64 - COUNT_BITS)
    at = np.minimum(np.searchsorted(known, short), max(len(known) - 1, 0))
    count = is_repeated(short, repeated).astype(np.int64)  # 0: of one document only, 1: rare, else its documents
    if len(known):
        count = np.where(known[at] == short, counts[at], count)
    order = np.lexsort((tokens, count, text))
    tokens, count = tokens[order], count[order]
    rank = np.arange(len(tokens)) - begins[text]
    overlap = -(-sizes * SIMILARITY // 100)
    short_prefix = sizes - overlap + 1
    single = (count == 1) & (rank < short_prefix[text])
    out_entries, out_nodes = [mix(tokens[single] + np.uint64(1))], [nodes[text[single]]]
    has_frequent = np.zeros(len(ends), bool)
    has_frequent[text[(count > 1) & (rank < short_prefix[text])]] = True
    if has_frequent.any():
        classes = length_classes(int(sizes.max()))
        own = np.searchsorted(classes, sizes, side="right") - 1
        for down in (0, 1):
            tag = np.maximum(own - down, 0)
            n_classes = np.maximum(classes[tag] // CLASS_TOKENS, 1)
            chosen = has_frequent[text] & (count > 1) & (rank < (short_prefix + n_classes)[text]) & (own >= down)[text]
            t, d = tokens[chosen], text[chosen]
            c = ((t >> np.uint64(8)) % n_classes[d].astype(np.uint64)).astype(np.int64)
            by_class = np.lexsort((t, c, d))
            t, d, c = t[by_class], d[by_class], c[by_class]
            step = 1
            while step < len(t):
                same = (d[step:] == d[:-step]) & (c[step:] == c[:-step])
                if not same.any():
                    break
                out_entries.append(mix(mix(t[:-step][same]) + t[step:][same] * np.uint64(3) + tag[d[:-step][same]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                out_nodes.append(nodes[d[:-step][same]])
                step += 1
    return np.concatenate(out_entries), np.concatenate(out_nodes)


def index_entries(docs: DataFrame, known_counts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """entry, node."""
    shared = docs.sparkSession.sparkContext.broadcast(known_counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                tokens, ends = sets_of(data, offsets)
                nodes = set_hash(tokens, ends)
                new = [not (x in seen or seen.add(x)) for x in nodes.tolist()]  # copies give the same entries
                entries, of = entries_of(*_chosen(tokens, ends, np.array(new, bool)), nodes[new], shared.value)
                yield from _batches({"entry": (_signed(entries), pa.int64()), "node": (_signed(of), pa.int64())})
            if len(seen) > SEEN:
                seen.clear()

    return docs.select("text").mapInArrow(run, "entry long, node long")


def _chosen(tokens: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(np.append(0, ends))
    return tokens[np.repeat(which, sizes)], np.cumsum(sizes[which])


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and parity sketches allow the similarity; none that has it is lost."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            differ = difference(*(np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for k in (4, 5)))
            # 100 common >= S union, with common = (n_a + n_b - differ) / 2 and union = (n_a + n_b + differ) / 2
            ok = 100 * (n_a + n_b - differ) >= SIMILARITY * (n_a + n_b + differ)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("n_a") * 100 >= F.col("n_b") * SIMILARITY) & (F.col("n_b") * 100 >= F.col("n_a") * SIMILARITY))
    return sized.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole sets, which are made again from the texts: those take less
    room on their way than sets of hashes."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.join(wanted, "node", "left_semi").select("node", "text_hash"), "ngram-wanted")
    hashed = docs.select(F.xxhash64("text").alias("text_hash"), "text")
    texts = maybe_known(hashed, "text_hash", known_words(wanted, "text_hash")).join(wanted, "text_hash").dropDuplicates(["text_hash"])
    texts = materialize(texts.select("node", "text"), "ngram-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 200) for i in range(0, whole.num_rows, 200)):
                ok = []
                sides = [[t for _, _, data, offsets in slices(batch.column(k)) for t in np.split(*_ends(*sets_of(data, offsets)))] for k in (2, 3)]
                for x, y in zip(*sides, strict=True):
                    ok.append(similar(x, y))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    met = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("of_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("of_b")), "b")
    return materialize(met.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long"), "ngram-links")


def _ends(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return tokens, ends[:-1]


def _near(places: list[int]) -> list:
    """Of a group: its members closest to fixed places, as distances."""
    return [F.min(F.col("node").bitwiseXOR(F.lit(c))).alias(f"l{k}") for k, c in enumerate(places)]


def star_pairs(met: DataFrame, places: list[int]) -> DataFrame:
    """(a, b): each node with the closest leader of its entries for each place.  met: node, l0, l1 ..."""
    closest = met.groupBy("node").agg(*[F.min(f"l{k}").bitwiseXOR(F.lit(c)).alias(f"l{k}") for k, c in enumerate(places)])
    pairs = closest.select("node", F.explode(F.array(*[f"l{k}" for k in range(len(places))])).alias("leader")).where("leader <> node")
    return pairs.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()


def node_components(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """node, component of every set that is linked with another."""
    known_counts = token_counts(docs, shuffle_partitions(docs.sparkSession))
    entries = materialize(index_entries(docs, known_counts), "ngram-entries")
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n_shingles").alias("n_shingles"), F.first("parity").alias("parity"))
    nodes = materialize(nodes, "ngram-nodes")
    places, later = PLACES[:FIRST_LEADERS], PLACES[FIRST_LEADERS:]
    heads = entries.groupBy("entry").agg(*_near(places), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").drop("lo", "hi")
    met = materialize(entries.join(heads, "entry").distinct(), "ngram-groups")
    seen = materialize(possible(star_pairs(met, places), nodes), "ngram-pairs")
    found = components(verified(seen, docs, nodes))
    members = mixed_members(met.select("entry", "node"), found)
    # what is left of large groups is nearly always linked with one of more leaders
    heads = members.groupBy("entry").agg(*_near(later))
    again = star_pairs(members.join(heads, "entry").drop("entry", "component"), later)
    again = materialize(possible(again.join(seen, ["a", "b"], "left_anti"), nodes), "ngram-pairs")
    found = components(_flat(found).unionByName(verified(again, docs, nodes)))
    return finish(members.select("entry", "node"), found, nodes, seen.unionByName(again), lambda pairs: verified(pairs, docs, nodes))


def finish(members: DataFrame, found: DataFrame, nodes: DataFrame, seen: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """found with all links that are left between members of one entry.  seen: pairs that are verified already.

    In the first rounds each component of a block meets the most similar set of the others only, which joins what is a
    large family of sets that no leader is linked with; the last round verifies every possible pair that is left."""
    for turn in range(CLOSEST_ROUNDS + 1):
        members = mixed_members(members.select(*[c for c in members.columns if c != "component"]), found)
        pairs = between_components(members, nodes, closest=turn < CLOSEST_ROUNDS)
        pairs = materialize(pairs.join(seen, ["a", "b"], "left_anti"), "ngram-pairs")
        if pairs.isEmpty():
            continue
        seen = seen.unionByName(pairs)
        found = components(_flat(found).unionByName(verify(pairs)))
    return found


def _flat(found: DataFrame) -> DataFrame:
    """Components as links, which need no more rounds of their own."""
    return found.select(F.col("node").alias("a"), F.col("component").alias("b"))


def mixed_members(met: DataFrame, found: DataFrame) -> DataFrame:
    """met(entry, node, any others) with component, of the entries with nodes of several components."""
    placed = met.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("entry").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("entry")
    return materialize(placed.join(mixed, "entry", "left_semi").select(*met.columns, "component"), "ngram-mixed")


def between_components(members: DataFrame, nodes: DataFrame, closest: bool = False) -> DataFrame:
    """Pairs (a, b) of different components that share an entry and whose sizes and parity sketches allow the similarity;
    closest: of each component in a block only the one that differs least, so fewer than there are members.

    Members of an entry are dealt to blocks of about BLOCK; each two blocks meet in one bounded group, in which numpy
    compares all sketches, and only the pairs that are possible leave it."""
    rows = members.join(nodes.select("node", "n_shingles", "parity"), "node")
    return in_blocks(rows, ["n_shingles", "parity"], lambda batches: _possible_pairs(batches, closest), "a long, b long").distinct()


def in_blocks(members: DataFrame, columns: list[str], run_groups: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run_groups makes of whole groups: two blocks of an entry's members, or one (same).  members: entry, node,
    component and the columns; rows of a group: group, same, first (of the first block), node, component, the columns."""
    parts = members.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = members.join(parts, "entry").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    groups = dealt.select("entry", "node", "component", "block", *columns, F.inline(meets))
    group = F.xxhash64("entry", "i", "j")
    rows = groups.select(group.alias("group"), (F.col("i") == F.col("j")).alias("same"), (F.col("block") == F.col("i")).alias("first"), "node", "component", *columns)
    rows = rows.repartition("group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group_of = batch.column(0).to_numpy(zero_copy_only=False)
            last = int(np.searchsorted(group_of, group_of[-1]))  # the last group may go on
            if last or held and held[-1].column(0)[-1].as_py() != group_of[0]:
                if last:
                    held.append(batch.slice(0, last))
                yield from run_groups(held)
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield from run_groups(held)

    return rows.mapInArrow(run, schema)


def _possible_pairs(batches: list[pa.RecordBatch], closest: bool) -> Iterator[pa.RecordBatch]:
    """Possible pairs within whole groups, rows sorted by group: each row against the one k places on, for k = 1, 2 ..."""
    group, same, first, node, component, n = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches]) for k in range(6))
    sketch = np.frombuffer(b"".join(x for b in batches for x in b.column(6).to_pylist()), np.uint64).reshape(len(group), -1)
    found: list[np.ndarray] = []
    least, partner = np.full(len(group), 2.0), np.full(len(group), -1)
    k = 1
    while k < len(group):
        at = np.flatnonzero(group[k:] == group[:-k])
        if not len(at):
            break
        to = at + k
        ok = (component[at] != component[to]) & (same[at] | (first[at] != first[to])) & (n[at] * 100 >= n[to] * SIMILARITY) & (n[to] * 100 >= n[at] * SIMILARITY)
        at, to = at[ok], to[ok]
        differ = difference(sketch[at], sketch[to])
        ok = 100 * (n[at] + n[to] - differ) >= SIMILARITY * (n[at] + n[to] + differ)
        at, to, differ = at[ok], to[ok], differ[ok]
        if closest:
            share = differ / (n[at] + n[to])
            for x, y in ((at, to), (to, at)):  # each row is once on either side
                better = share < least[x]
                least[x[better]], partner[x[better]] = share[better], y[better]
        elif len(at):
            found.append(np.sort(np.stack([node[at], node[to]]), axis=0))
        k += 1
    if closest and (partner >= 0).any():
        at = np.flatnonzero(partner >= 0)
        at = at[np.lexsort((least[at], component[at], group[at]))]
        at = at[np.append(True, (np.diff(group[at]) != 0) | (np.diff(component[at]) != 0))]
        found.append(np.sort(np.stack([node[at], node[partner[at]]]), axis=0))
    if found:
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        yield from _batches({"a": (pairs[0], pa.int64()), "b": (pairs[1], pa.int64())})


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links), text_hash and kept of every document.

    kept: all with an empty set, and of each component the text of the smallest doc_id (null last), then of the smallest hash."""
    sets = materialize(documents_as_sets(docs), "ngram-sets")
    found = node_components(docs, sets)
    placed = sets.select("doc_id", "text_hash", "n_shingles", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    smallest = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(place).alias("first"))
    kept = F.col("component").isNull() | (F.col("text_hash") == F.col("first.text_hash")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    return placed.join(smallest, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", kept.alias("kept"))
