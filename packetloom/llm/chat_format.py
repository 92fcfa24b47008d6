"""Chat formatting with a loss mask, by columnar byte assembly.

A turn is written `### role: text </turn>` and a line feed.  Inside roles and texts every backslash,
`###` and `</turn>` gets a backslash before it, and so does `: ` inside roles: the template can be
read back exactly.

Segment lengths, cumulative offsets and scatter indices are numpy arrays; headers, contents and
footers of a whole batch are copied into one preallocated Arrow buffer.

Conversations are dealt by conv_id and sorted by turn; the sorted stream is cut into parts of at most
`part_chars` characters (or one turn), so a conversation of any length takes bounded memory.

Defined results: a null text or role is empty; rows of a null conv_id form one conversation; a null
turn comes first; equal turns are ordered by role, then text; repeated rows stay; an empty table gives no
rows; columns other than conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, AFTER_ROLE, CLOSE = b"### ", b": ", b" </turn>\n"
_CONTROL, _ROLE_CONTROL = r"(\\|###|</turn>)", r"(\\|###|</turn>|: )"
_ESCAPED = re.compile(r"\\(\\|###|</turn>|: )")
PART_CHARS = 4_000_000
PARTS = "conv_id long, part long, n_turns long, formatted string, loss_spans array<struct<begin:long,end:long>>"


def escape(column: pa.Array, control: str = _CONTROL) -> pa.Array:
    return pc.replace_substring_regex(column.cast(pa.large_string()), pattern=control, replacement=r"\\\1")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns in one buffer, where each turn begins, and where its text begins in it."""
    n = len(roles)
    pieces = [(OPEN, None), (None, roles), (AFTER_ROLE, None), (None, texts), (CLOSE, None)]
    lengths = np.empty((n, len(pieces)), np.int64)
    sources = []
    for k, (fixed, column) in enumerate(pieces):
        if fixed is not None:
            lengths[:, k] = len(fixed)
            sources.append((np.frombuffer(fixed, np.uint8), None))
        else:
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
            lengths[:, k] = np.diff(offsets)
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            sources.append((data[offsets[0] : offsets[-1]], offsets - offsets[0]))
    begins = np.append(0, np.cumsum(lengths.ravel()))
    starts = begins[:-1].reshape(n, len(pieces))
    out = np.empty(begins[-1], np.uint8)
    for k, (data, offsets) in enumerate(sources):
        if offsets is None:
            out[(starts[:, k, None] + np.arange(len(data))).ravel()] = np.tile(data, n)
        else:
            out[np.repeat(starts[:, k] - offsets[:-1], lengths[:, k]) + np.arange(len(data))] = data
    return out, np.append(starts[:, 0], begins[-1]), starts[:, 3]


def chat_format(conversations: DataFrame, loss_role: str = "assistant", part_chars: int = PART_CHARS) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss_spans (character positions in formatted: the escaped texts
    of loss_role).  A conversation's parts follow each other in one partition."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role"), empty("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict | None = None

        def new(conv, part):
            return {"conv": conv, "part": part, "turns": 0, "text": [], "chars": 0, "spans": []}

        def rows_of(done: list[dict]) -> pa.RecordBatch:
            spans = [[{"begin": a, "end": b} for a, b in x["spans"]] for x in done]
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([x["conv"] for x in done], pa.int64()), pa.array([x["part"] for x in done], pa.int64()), pa.array([x["turns"] for x in done], pa.int64()), pa.array(["".join(x["text"]) for x in done], pa.string()), pa.array(spans, kind)], names=["conv_id", "part", "n_turns", "formatted", "loss_spans"])

        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, max(1, whole.num_rows), 2000)):
                if not batch.num_rows:
                    continue
                plain_role = batch.column(2).to_pylist()
                roles, texts = escape(batch.column(2), _ROLE_CONTROL), escape(batch.column(3))
                data, begins, text_begins = assemble(roles, texts)
                one_char = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before each byte
                text_chars = one_char[text_begins + pc.binary_length(texts).to_numpy(zero_copy_only=False)] - one_char[text_begins]
                done: list[dict] = []
                for i, conv in enumerate(batch.column(0).to_pylist()):
                    a, b = begins[i], begins[i + 1]
                    chars = int(one_char[b] - one_char[a])
                    if open_ is None or open_["conv"] != conv or open_["chars"] + chars > part_chars:
                        if open_ is not None:
                            done.append(open_)
                        open_ = new(conv, open_["part"] + 1 if open_ is not None and open_["conv"] == conv else 0)
                    if plain_role[i] == loss_role:
                        at = open_["chars"] + int(one_char[text_begins[i]] - one_char[a])
                        open_["spans"].append((at, at + int(text_chars[i])))
                    open_["text"].append(data[a:b].tobytes().decode())
                    open_["chars"] += chars
                    open_["turns"] += 1
                if done:
                    yield rows_of(done)
        if open_ is not None:
            yield rows_of([open_])

    return rows.mapInArrow(run, PARTS)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    turns, at = [], 0
    while at < len(formatted):
        end = formatted.find("</turn>\n", at)
        while end > 0 and _odd_backslashes(formatted, end):
            end = formatted.find("</turn>\n", end + 1)
        body = formatted[at + len(OPEN) : end - 1]
        role, text = _split_role(body)
        turns.append((unescape(role), unescape(text)))
        at = end + len("</turn>\n")
    return turns


def _odd_backslashes(text: str, end: int) -> bool:
    n = 0
    while end - n > 0 and text[end - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def _split_role(body: str) -> tuple[str, str]:
    at = body.find(": ")
    while _odd_backslashes(body, at):
        at = body.find(": ", at + 1)
    return body[:at], body[at + 2 :]


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of what the formatted parts say, read from them alone: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.  Needs the parts in the order in which chat_format leaves them."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def row():
            return [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if state is None or x["part"] == 0:
                    if state is not None:
                        out.append(row())
                    conv, state = x["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = x["formatted"]
                for role, said in read_turns(text):
                    state[1].update(f"{role}\n{said}\n".encode())
                    state[0] += 1
                for span in x["loss_spans"]:
                    said = unescape(text[span["begin"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if out:
                yield _rows(out)
        if state is not None:
            yield _rows([row()])

    def _rows(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return parts.mapInArrow(run, schema)
