"""Token ids as binary files with keyed access by a minimal perfect hash.

A folder holds
    shard-N.ids   raw little-endian ids, document after document, 2 bytes each where the vocabulary allows it, else 4
    shard-N.docs  for each of its documents: id, whether the id is null, number of ids
    index-N.mph   for some buckets of keys: a minimal perfect hash, and a slot for each key with a fingerprint of the key,
                  shard, offset and number of ids; ends with where each bucket lies
    manifest.json width, buckets, index files, and for each shard the ids and documents before it; written last

Documents lie in ascending order of their ids (nulls first, equal ids in the order of their texts' hashes), each followed by
the end id.  A key is (doc_id, nth): nth counts the documents of one id from 0.

The minimal perfect hash of a bucket puts each key at a place of a bit array; keys that meet go on to the next, smaller
array.  A key's slot is the rank of its bit, from counts at every 64 bytes: a lookup reads as much whatever the number of keys.

Every file is written under a name of its own and then renamed, so a task that runs again leaves the same files.  The shards are
read and written through pyarrow's file systems.

Defined results: a null text is empty, so it is the end id alone; a null doc_id is a key like others; repeated rows are documents
of their own; an empty table gives a manifest without shards and no rows; columns other than doc_id and text are ignored,
whatever their names; a key that isn't there gives no row (one in four thousand million is taken for another).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialize, shared_dir, shuffle_partitions
from .packing import encoder

END = 0
#: Ids of a shard and keys of a bucket, about; buckets of an index file where there are many.
SHARD_IDS, BUCKET_KEYS, FILE_BUCKETS = 1 << 27, 4096, 64
#: Places of a bit array for each key that comes to it; levels of arrays at most.
SPREAD, LEVELS = 2, 64
_DOC = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8")])
_SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8")])
_PLACE = np.dtype([("begin", "<u8"), ("length", "<u8")])
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


# --- files -------------------------------------------------------------------------------------------
def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path on it, of a path with or without a scheme."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


class _Output:
    """A file that gets its name when it is complete."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _at(folder)
        self.final, self.own = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.own)

    def write(self, data: bytes) -> None:
        self.stream.write(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.own, self.final)


def _read(folder: str, name: str, begin: int = 0, length: int | None = None) -> bytes:
    """length bytes of a file from begin on; all that follow unless length is given, the last ones where begin is negative."""
    files, root = _at(folder)
    with files.open_input_file(f"{root}/{name}") as f:
        begin = f.size() + begin if begin < 0 else begin
        return f.read_at(f.size() - begin if length is None else length, begin)


def manifest(folder: str) -> dict:
    return json.loads(_read(folder, "manifest.json"))


# --- the minimal perfect hash of a bucket ---------------------------------------------------------------
def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """Well spread 64 bits from a key's two hashes, other ones at each level."""
    x = a + b * np.uint64(2 * level + 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _levels(a: np.ndarray, b: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels, and their bits in bytes, in multiples of 64."""
    sizes, bits = [], []
    left = np.arange(len(a))
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError(f"{len(left)} keys have equal hashes")
        size = -(-max(SPREAD * len(left), 64) // 8) * 8
        places = (_mixed(a[left], b[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(places, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left = left[~alone[places]]
    packed = np.packbits(np.concatenate(bits), bitorder="little") if bits else np.empty(0, np.uint8)
    return sizes, np.append(packed, np.zeros(-len(packed) % 64, np.uint8))


def _ranks(sizes: list[int], bits: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 for keys that are surely not there."""
    found = np.full(len(a), -1, np.int64)
    left, begin = np.arange(len(a)), 0
    for level, size in enumerate(sizes):
        at = begin + (_mixed(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
        here = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        found[left[here]] = at[here]
        left, begin = left[~here], begin + size
    at = found[found >= 0]
    block = bits.reshape(-1, 64)[at >> 9]  # the 64 bytes around each place
    byte = (at >> 3) & 63
    before = np.where(np.arange(64) < byte[:, None], _ONES[block], 0).sum(axis=1, dtype=np.int64)
    last = block[np.arange(len(at)), byte] & ((1 << (at & 7)) - 1).astype(np.uint8)
    found[found >= 0] = counts[at >> 9] + before + _ONES[last]
    return found


def build_bucket(a: np.ndarray, b: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """A bucket as stored: numbers of keys and levels, sizes, bits, counts and slots."""
    sizes, bits = _levels(a, b)
    counts = np.append(0, np.cumsum(_ONES[bits].reshape(-1, 64).sum(axis=1, dtype=np.int64)))[:-1]
    slots = np.empty(len(a), _SLOT)
    order = _ranks(sizes, bits, counts, a, b)
    for name, values in (("fingerprint", _fingerprint(a, b)), ("shard", shard), ("at", at), ("n", n)):
        slots[name][order] = values
    return struct.pack(f"<QQ{len(sizes)}Q", len(a), len(sizes), *sizes) + bits.tobytes() + counts.astype("<u4").tobytes() + slots.tobytes()


def _fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_mixed(a, b, LEVELS) >> np.uint64(32)).astype(np.uint32)


def find_in_bucket(bucket: bytes, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the bucket has, and the slots of those."""
    if not bucket:
        return np.zeros(len(a), bool), np.empty(0, _SLOT)
    n, n_levels = struct.unpack_from("<QQ", bucket)
    sizes = list(struct.unpack_from(f"<{n_levels}Q", bucket, 16))
    begin, n_bytes = 16 + 8 * n_levels, -(-sum(sizes) // 512) * 64
    bits = np.frombuffer(bucket, np.uint8, n_bytes, begin)
    counts = np.frombuffer(bucket, "<u4", n_bytes // 64, begin + n_bytes).astype(np.int64)
    slots = np.frombuffer(bucket, _SLOT, n, begin + n_bytes + n_bytes // 16)
    ranks = _ranks(sizes, bits, counts, a, b)
    there = ranks >= 0
    there[there] = slots["fingerprint"][ranks[there]] == _fingerprint(a, b)[there]
    return there, slots[ranks[there]]


def read_bucket(folder: str, bucket: int, n_files: int, n_buckets: int) -> bytes:
    """A bucket's bytes: its file's end says where they are."""
    name, k = f"index-{bucket % n_files}.mph", bucket // n_files
    of_file = -(-(n_buckets - bucket % n_files) // n_files)
    begin, length = struct.unpack("<QQ", _read(folder, name, -(of_file - k) * _PLACE.itemsize)[: _PLACE.itemsize])
    return _read(folder, name, begin, length)


# --- writing -------------------------------------------------------------------------------------------
def _hashes(df: DataFrame) -> DataFrame:
    """_a, _b: two hashes of the key (doc_id, nth)."""
    return df.withColumn("_a", F.xxhash64("doc_id", "nth")).withColumn("_b", F.xxhash64("nth", F.lit("b"), "doc_id"))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (doc_id, row, ...) with nth.  Rows of one id follow each other, so nth is the distance to the id's first row;
    only ids with several rows are joined."""
    several = rows.groupBy(F.col("doc_id").alias("_id")).agg(F.min("row").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return rows.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("nth", F.coalesce(F.col("row") - F.col("_first"), F.lit(0))).drop("_id", "_first")


def _shard_writer(folder: str, tokenizer_path: str, width: int, shard_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(tokenizer_path), TaskContext.get().partitionId() << 20
        made, at, row, payload = 0, 0, 0, None
        docs: list[bytes] = []

        def close() -> None:
            nonlocal made, at, row, payload, docs
            payload.close()
            directory = _Output(folder, f"shard-{first + made}.docs")
            directory.write(b"".join(docs))
            directory.close()
            made, at, row, payload, docs = made + 1, 0, 0, None, []

        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                out: list[tuple] = []
                for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                    ids = np.append(encode(text.as_py() or ""), END)
                    if payload is not None and at + len(ids) > shard_ids:
                        close()
                    payload = payload or _Output(folder, f"shard-{first + made}.ids")
                    payload.write(ids.astype(f"<u{width}").tobytes())
                    doc = doc_id.as_py()
                    docs.append(np.array([(doc or 0, doc is None, len(ids))], _DOC).tobytes())
                    out.append((doc, first + made, row, at, len(ids)))
                    at, row = at + len(ids), row + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "shard", "in_shard", "at", "n"])
        if payload is not None:
            close()

    return run


def _index_writer(folder: str, n_files: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        output, file, places, at, held, bucket, written = None, None, [], 0, [], None, []

        def put() -> None:
            nonlocal held, at
            if held:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                data = build_bucket(columns[0].view(np.uint64), columns[1].view(np.uint64), *columns[2:])
                output.write(data)
                places.extend([(at, 0)] * (bucket // n_files - len(places)))
                places.append((at, len(data)))
                written.append((file, len(columns[0])))
                at, held = at + len(data), []

        def close() -> None:
            nonlocal output, places, at
            if output is not None:
                put()
                places.extend([(at, 0)] * (-(-(n_buckets - file) // n_files) - len(places)))
                output.write(np.array(places, _PLACE).tobytes())
                output.close()
            output, places, at = None, [], 0

        for batch in batches:
            buckets = batch.column(0).to_numpy()
            rest = [c.to_numpy() for c in batch.columns[1:]]
            for begin, end in _runs(buckets):
                if buckets[begin] != bucket:
                    put()
                    bucket = int(buckets[begin])
                    if bucket % n_files != file or output is None:
                        close()
                        file = bucket % n_files
                        output = _Output(folder, f"index-{file}.mph")
                held.append([c[begin:end] for c in rest])
        close()
        if written:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*written, strict=True)], names=["file", "n_keys"])

    return run


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal values begin and end."""
    cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return list(zip(cuts, cuts[1:])) if len(values) else []


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, shard_ids: int = SHARD_IDS) -> dict:
    """Write the ids of docs (doc_id, text) to a new folder; returns its manifest."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    files, root = _at(folder)
    files.create_dir(root, recursive=True)
    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h")).repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    entries = materialize(rows.mapInArrow(_shard_writer(folder, tokenizer_path, width, shard_ids), "doc_id long, shard long, in_shard long, at long, n long"), "entries")
    sizes = entries.groupBy("shard").agg(F.sum("n").alias("ids"), F.count("*").alias("docs")).orderBy("shard").collect()  # a row for each file
    shards, ids, n_docs = [], 0, 0
    for r in sizes:
        shards.append([r["shard"], ids, n_docs])
        ids, n_docs = ids + r["ids"], n_docs + r["docs"]
    n_buckets = max(1, -(-n_docs // BUCKET_KEYS))
    n_files = max(-(-n_buckets // FILE_BUCKETS), min(n_buckets, shuffle_partitions(spark)))
    of_shard = spark.createDataFrame([(name, k, before) for k, (name, _, before) in enumerate(shards)], "name long, number long, before long")
    keyed = _numbered(entries.join(of_shard, F.col("shard") == F.col("name")).select("doc_id", (F.col("before") + F.col("in_shard")).alias("row"), "number", "at", "n"))
    keyed = _hashes(keyed).withColumn("bucket", F.pmod("_a", F.lit(n_buckets)).cast("long")).select("bucket", "_a", "_b", "number", "at", "n")
    dealt = keyed.repartition(n_files, F.col("bucket") % n_files).sortWithinPartitions(F.col("bucket") % n_files, "bucket")
    indexed = materialize(dealt.mapInArrow(_index_writer(folder, n_files, n_buckets), "file long, n_keys long"), "indexed").agg(F.sum("n_keys")).first()[0] or 0
    if indexed != n_docs:
        raise ValueError(f"the index has {indexed} keys for {n_docs} documents")
    made = {"width": width, "n_ids": ids, "n_docs": n_docs, "n_buckets": n_buckets, "n_files": n_files, "shards": shards}
    output = _Output(folder, "manifest.json")
    output.write(json.dumps(made).encode())
    output.close()
    return made


# --- reading -------------------------------------------------------------------------------------------
def keys(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, nth of all documents, from the shards' directories."""
    shards = manifest(folder)["shards"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                docs = np.frombuffer(_read(folder, f"shard-{name}.docs"), _DOC)
                for k in range(0, len(docs), 100_000):
                    some = docs[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(some["id"], pa.int64(), mask=some["null"] == 1), pa.array(before + k + np.arange(len(some)))], names=["doc_id", "row"])

    listed = spark.createDataFrame([(name, before) for name, _, before in shards], "name long, before long").repartition(max(1, len(shards)), "name")
    return _numbered(listed.mapInArrow(run, "doc_id long, row long")).select("doc_id", "nth")


def lookup(wanted: DataFrame, folder: str) -> DataFrame:
    """doc_id, nth, shard, at, n of the wanted keys (doc_id, nth) that the index has; each bucket is read once."""
    made = manifest(folder)
    n_files, n_buckets = made["n_files"], made["n_buckets"]
    rows = _hashes(wanted.select("doc_id", "nth")).withColumn("bucket", F.pmod("_a", F.lit(n_buckets)).cast("long"))
    rows = rows.repartition(n_files, F.col("bucket") % n_files).sortWithinPartitions("bucket").select("bucket", "_a", "_b", "doc_id", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, data = None, b""
        for batch in batches:
            buckets, a, b = (batch.column(i).to_numpy() for i in range(3))
            for begin, end in _runs(buckets):
                if buckets[begin] != number:
                    number = int(buckets[begin])
                    data = read_bucket(folder, number, n_files, n_buckets) if made["n_docs"] else b""
                there, slots = find_in_bucket(data, a[begin:end].view(np.uint64), b[begin:end].view(np.uint64))
                found = batch.slice(begin, end - begin).filter(pa.array(there))
                yield pa.RecordBatch.from_arrays([found.column(3), found.column(4), *(pa.array(slots[c].astype(np.int64)) for c in ("shard", "at", "n"))], names=["doc_id", "nth", "shard", "at", "n"])

    return rows.mapInArrow(run, "doc_id long, nth long, shard long, at long, n long")


def read_ids(places: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """doc_id, nth, start, n_tokens, ids_crc32[, ids] of looked up places.  Places are dealt in the order of the files, so a task
    reads neighbouring documents of few shards."""
    made = manifest(folder)
    width, shards = made["width"], made["shards"]
    schema = "doc_id long, nth long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    n_tasks = max(1, len(shards))
    rows = places.select("doc_id", "nth", "shard", "at", "n").repartitionByRange(n_tasks, "shard", "at").sortWithinPartitions("shard", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _at(folder)
        number, stream = None, None
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                out: list[tuple] = []
                for doc_id, nth, shard, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if shard != number:
                        if stream is not None:
                            stream.close()
                        number, stream = shard, files.open_input_file(f"{root}/shard-{shards[shard][0]}.ids")
                    ids = np.frombuffer(stream.read_at(n * width, at * width), f"<u{width}").astype("<u4")
                    out.append((doc_id, nth, shards[shard][1] + at, len(ids), zlib.crc32(ids.tobytes()), *([ids.astype(np.int32)] if with_ids else [])))
                kinds = [*[pa.int64()] * 5, pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names=["doc_id", "nth", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])
        if stream is not None:
            stream.close()

    return rows.mapInArrow(run, schema)


class Reader:
    """Ids of single documents, for a process of its own such as a training loader: one read in the index's end, one of
    a bucket, one of the payload."""

    def __init__(self, folder: str):
        self.folder, self.made = folder, manifest(folder)
        self._bucket = lru_cache(maxsize=64)(lambda k: read_bucket(folder, k, self.made["n_files"], self.made["n_buckets"]))

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        import xxhash

        def chained(*values) -> int:
            seed = 42
            for v in values:
                if v is not None:
                    seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), seed)
            return seed

        a, b = chained(doc_id, nth), chained(nth, b"b", doc_id)
        if not self.made["n_docs"]:
            return None
        bucket = (a - (1 << 64) if a >> 63 else a) % self.made["n_buckets"]
        there, slots = find_in_bucket(self._bucket(bucket), np.array([a], np.uint64), np.array([b], np.uint64))
        if not there[0]:
            return None
        width, shard, at, n = self.made["width"], *(int(slots[c][0]) for c in ("shard", "at", "n"))
        return np.frombuffer(_read(self.folder, f"shard-{self.made['shards'][shard][0]}.ids", at * width, n * width), f"<u{width}").astype(np.uint32)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write docs to the shared folder, then read every document back by its key."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    write_ids(docs, folder, tokenizer_path)
    return read_ids(lookup(keys(spark, folder), folder), folder, with_ids=False)
