"""Best-fit packing of tokenised documents into fixed-length sequences.

Hierarchical residual packing: groups of items are packed best-fit on their own, bins that are
nearly full are emitted, and the underfull rest goes up a merge tree, where whole bins are the
items of the next best-fit round.  What travels are lengths and a few long columns, never tokens.

Defined results: a null text counts as empty and is one piece of one token (the separator); a null
doc_id stays null; repeated rows are packed each on their own; an empty table gives no rows; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

CAPACITY = 2048
#: Items of one group of the first round; groups that merge into one; bins that a group hands up at most.
GROUP_ITEMS, FAN_IN, CARRY = 50_000, 8, 4_096
#: Documents whose ids a tokenizing task holds at once.
SLICE = 500
#: A bin with at most this many places left is nearly full.
SLACK = 4
#: Characters on which the two tokenizer libraries' patterns agree by construction.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")


class Encoder:
    """Token ids of a `tokenizers` file.  A byte-level BPE is merged by tiktoken from the same vocabulary
    where a text has only plain characters and no special token; all other texts go to `tokenizers`."""

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(path)
        spec = json.loads(self.reference.to_str())
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = None
        before = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer") and _in_order(spec["model"]):
            byte_of = _byte_alphabet()
            ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.specials}
            if len(ranks) + len(self.specials) >= len(spec["model"]["vocab"]):
                pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
                self.fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _PLAIN.search(text) and not any(s in text for s in self.specials):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.reference.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _in_order(model: dict) -> bool:
    """Whether ids rise with the order of merges, and every token of several characters comes from one: only then does
    merging by ids give what merging by the list gives."""
    merged = ["".join(m) if not isinstance(m, str) else m.replace(" ", "", 1) for m in model["merges"]]
    ids = [model["vocab"].get(t, -1) for t in merged]
    rising = all(a < b for a, b in zip(ids, ids[1:])) and (not ids or ids[0] >= 0)
    return rising and not model.get("dropout") and not model.get("ignore_merges") and all(len(t) == 1 or t in set_ for set_ in [set(merged)] for t in model["vocab"] if not t.startswith("<|"))


def _byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in a byte-level vocabulary: printable bytes are themselves,
    the others follow from code point 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32[, ids]: each document's ids and a final 0, cut only if longer
    than capacity; then all pieces but the first are full."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what other tasks of this worker have left
        encode = encoder(tokenizer_path)
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            out: list[list] = [[] for _ in range(6 if with_ids else 5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4", copy=False)
                n = len(ids)
                first = n if n <= capacity else (n % capacity or capacity)
                for piece, (a, b) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n, capacity), n], strict=True)):
                    part = ids[a:b]
                    for column, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(part.tobytes()), part), strict=False):
                        column.append(value)
            arrays = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                offsets = np.append(0, np.cumsum(out[3], dtype=np.int64)).astype(np.int32)
                values = np.concatenate(out[5]).astype(np.int32) if out[5] else np.empty(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: items from large to small, each into the fullest bin that it fits."""
    bins = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by places left
    waiting, made = 0, 0  # bit r of waiting: a bin with r places left
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        above = waiting >> size
        if above:
            left = size + (above & -above).bit_length() - 1
            stack = open_bins[left]
            b = stack.pop()
            if not stack:
                waiting &= ~(1 << left)
        else:
            b, left, made = made, capacity, made + 1
        bins[i] = b
        left -= size
        if left:
            open_bins[left].append(b)
            waiting |= 1 << left
    return bins


def pack(items: DataFrame, columns: Sequence[str], capacity: int = CAPACITY, length: str = "length", key: Sequence[str] | None = None) -> DataFrame:
    """The given long columns of items (length among them, 1..capacity) with sequence_id and offset.

    Items are dealt to groups by a hash of the key columns (all columns unless given), so that each group has the same
    mix of lengths and its own underfull rest is small; the carry bound therefore only closes bins early, it drops nothing.
    Which bin an item gets may depend on it."""
    columns, key = list(columns), list(key or columns)
    width, at = len(columns), columns.index(length)
    n_groups = max(1, -(-items.count() // GROUP_ITEMS))
    group = F.pmod(F.xxhash64(*key), F.lit(n_groups)).alias("grp")
    items = items.select(*[F.col(c).cast("long").alias(c) for c in columns], group)
    out_schema = "size long, members binary, closed boolean, sequence_id long, grp long"

    def packed(rows: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, level: int, group: int, root: bool) -> pd.DataFrame:
        """rows: every member of every item; offsets: where an item's members begin."""
        bins = best_fit(sizes, capacity)
        n = int(bins.max()) + 1 if len(bins) else 0
        fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        counts = np.diff(offsets)
        member_at = np.repeat(offsets[:-1][order] - np.append(0, np.cumsum(counts[order])[:-1]), counts[order]) + np.arange(len(rows))
        per_bin = np.append(0, np.cumsum(np.bincount(bins, weights=counts, minlength=n))).astype(np.int64)
        closed = np.full(n, root) | (fill >= capacity - SLACK)
        waiting = np.flatnonzero(~closed)
        closed[waiting[np.argsort(fill[waiting], kind="stable")[CARRY:]]] = True
        data = np.ascontiguousarray(rows[member_at]).tobytes()
        step = 8 * (width + 0)
        return pd.DataFrame({
            "size": fill, "members": [data[a * step : b * step] for a, b in zip(per_bin[:-1], per_bin[1:], strict=True)], "closed": closed,
            "sequence_id": (np.int64(level) << 56) + (np.int64(group) << 28) + np.arange(n), "grp": group,
        })

    def step(level: int, root: bool):
        def of_items(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            rows = np.stack([pdf[c].fillna(_NULL).to_numpy(np.int64) if pdf[c].dtype != np.int64 else pdf[c].to_numpy() for c in columns], axis=1)
            return packed(rows, np.arange(len(rows) + 1), rows[:, at], level, int(key_[0]), root)

        def of_bins(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            rows = np.frombuffer(b"".join(pdf["members"]), np.int64).reshape(-1, width)
            offsets = np.append(0, np.cumsum(pdf["members"].str.len().to_numpy() // (8 * width)))
            return packed(rows, offsets, pdf["size"].to_numpy(np.int64), level, int(key_[0]), root)

        return of_bins if level else of_items

    level, grouped, done = 0, items, []
    while True:
        bins = materialize(grouped.groupBy("grp").applyInPandas(step(level, n_groups == 1), out_schema), f"pack-{level}")
        done.append(bins.where("closed"))
        if n_groups == 1:
            break
        level, n_groups = level + 1, -(-n_groups // FAN_IN)
        grouped = bins.where("not closed").select("size", "members", F.pmod("grp", F.lit(n_groups)).alias("grp"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            rows = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, width)
            counts = np.array([len(x) for x in blobs], np.int64) // (8 * width)
            sequence = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), counts)
            ends = np.cumsum(rows[:, at])
            begun = np.repeat(np.append(0, ends)[np.append(0, np.cumsum(counts))[:-1]], counts) if len(rows) else np.empty(0, np.int64)
            arrays = [pa.array(rows[:, i], pa.int64(), mask=rows[:, i] == _NULL) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence, pa.int64()), pa.array(ends - rows[:, at] - begun, pa.int64())], names=[*columns, "sequence_id", "offset"])

    closed = done[0]
    for more in done[1:]:
        closed = closed.unionByName(more)
    schema = ", ".join(f"`{c}` long" for c in [*columns, "sequence_id", "offset"])
    return closed.select("sequence_id", "members").mapInArrow(spread, schema)


#: Stands for a null among the long columns while they travel as bytes.
_NULL = np.iinfo(np.int64).min


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    pieces = tokenize_pieces(docs, tokenizer_path, capacity, with_ids=False)
    # numbers that the written table keeps: rows of one id, or of none, are dealt to all groups
    pieces = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    packed = pack(pieces, ["doc_id", "piece", "start", "length", "ids_crc32"], capacity, key=["row"])
    return packed.withColumn("piece", F.col("piece").cast("int"))


def sequences(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, length, ids array<int>: the token sequences themselves.  doc_id must be unique here.
    Each group of this one holds at most capacity tokens."""
    pieces = tokenize_pieces(docs, tokenizer_path, capacity).select("doc_id", "piece", "ids")
    joined = packed.join(pieces, (packed.doc_id.eqNullSafe(pieces.doc_id)) & (packed.piece == pieces.piece)).select("sequence_id", "offset", "ids")
    parts = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids")).withColumn("length", F.size("ids").cast("long"))
