"""Streaming sources over files that grow: lines, such as event records, and packets of captures.

Offsets are byte positions by file, up to which a file holds whole lines or records.  Spark keeps them in the checkpoint, so a
query that starts again reads the same ranges again, and goes on where it stood: nothing is lost or repeated.  A file that has become
shorter than its offset is another file (its log was rotated): it is read from its start.  One that was replaced by a longer one
can't be told from one that has grown.

    spark.dataSource.register(live.LineTail)
    spark.readStream.format("line_tail").option("path", folder).load()"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import captures

#: Bytes of a partition, about.
PART_BYTES = 8_000_000


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return captures._opened(path)


class _Tail(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path, self.last = path, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _files(self) -> dict[str, int]:
        """Files and their sizes."""
        store, place = _store(self.path)
        info = store.get_file_info(place)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(place, allow_not_found=True))
        return {f.path: f.size for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_"))}

    def latestOffset(self) -> dict:  # noqa: N802
        ends = {}
        for path, size in self._files().items():
            begin = self.last.get(path, 0)
            ends[path] = self.whole(path, 0 if size < begin else begin, size, size)
        self.last = dict(ends)
        return ends

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if stop < begin else begin
            while begin < stop:
                upto = stop if stop - begin <= PART_BYTES else self.whole(path, begin, begin + PART_BYTES, stop)
                out.append(Range(path, begin, upto))
                begin = upto
        return out

    def commit(self, end: dict) -> None:
        """Nothing to forget: files keep what was read."""

    def _bytes(self, path: str, begin: int, end: int) -> bytes:
        store, place = _store(self.path)
        with store.open_input_file(path) as f:
            return f.read_at(end - begin, begin)


class _LineReader(_Tail):
    def whole(self, path: str, begin: int, end: int, size: int) -> int:
        """End of the last whole line before end, or of the first one after it; begin if there is none."""
        step, at = 1 << 16, end
        while at > begin:
            low = max(begin, at - step)
            found = self._bytes(path, low, at).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
        at = end
        while at < size:
            found = self._bytes(path, at, min(size, at + step)).find(b"\n")
            if found >= 0:
                return at + found + 1
            at += step
        return begin

    def read(self, partition: Range) -> Iterator[tuple]:
        for line in self._bytes(partition.path, partition.begin, partition.end).split(b"\n")[:-1]:
            yield (line.removesuffix(b"\r").decode("utf-8", "replace"),)


class _PacketReader(_Tail):
    """Classic captures; numbers of packets are their byte positions, which rise with arrival."""

    def _head(self, path: str) -> tuple[str, float] | None:
        return captures.MAGIC.get(self._bytes(path, 0, 4))

    def whole(self, path: str, begin: int, end: int, size: int) -> int:
        """End of the last whole record that ends before end, or of the first one."""
        head = self._head(path)
        at = max(begin, 24)
        if head is None or size < 24:
            return begin
        while at + 16 <= size:
            (kept,) = struct.unpack(f"{head[0]}I", self._bytes(path, at + 8, at + 12))
            after = at + 16 + kept
            if after > size or (after > end and at > max(begin, 24)):
                break
            at = after
        return at

    def read(self, partition: Range) -> Iterator[tuple]:
        order, unit = self._head(partition.path)
        at = max(partition.begin, 24)
        for ts, length, data in captures._classic(self._bytes(partition.path, at, partition.end), order, unit):
            if fields := captures.frame(data):
                fields |= {"ts": ts, "seq": at, "frame_len": length}
                yield tuple(fields.get(f) for f in captures._FIELDS)
            at += 16 + len(data)


class LineTail(DataSource):
    """value: the lines of a file or of a folder's files as they are appended."""

    reader_class, columns = _LineReader, "value string"

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return self.columns

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return self.reader_class(self.options["path"])


class PacketTail(LineTail):
    """Packets of captures that are being written."""

    reader_class, columns = _PacketReader, captures.SCHEMA

    @classmethod
    def name(cls) -> str:
        return "packet_tail"
