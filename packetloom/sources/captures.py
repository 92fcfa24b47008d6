"""Packets from capture files: classic pcap (both byte orders, micro- and nanoseconds) and the newer format, with Ethernet frames.

Records can't be found without passing over those before them, so a first pass reads only lengths and notes where every
RANGE packets begin; a task of it reads a file as a stream and holds one buffer.  Then every range is a task's row of its own:
one large file is parsed by many tasks, none of which holds more than a range."""

from __future__ import annotations

import re
import socket
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

MAX_PACKETS = 25_000
#: Packets of a range, and bytes, at most (or one packet).
RANGE, RANGE_BYTES = 20_000, 8_000_000
MAGIC = {b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e9), b"\x4d\x3c\xb2\xa1": ("<", 1e9)}
PCAPNG = b"\x0a\x0d\x0d\x0a"
SCHEMA = "ts double, seq long, src_ip string, dst_ip string, src_port int, dst_port int, proto int, frame_len int, tcp_flags int, ihl int, dns_qname string, arp_op int, icmp_type int, dns_opcode int, dns_rcode int, payload string, http_uri string"
_FIELDS = [x.split()[0] for x in SCHEMA.split(", ")]
_KINDS = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "int": pa.int32()}
_TYPES = [_KINDS[x.split()[1]] for x in SCHEMA.split(", ")]


def records(data: bytes) -> Iterator[tuple[float, int, bytes]]:
    """Time, original length and bytes of each frame of a whole capture."""
    if data[:4] == PCAPNG:
        return _blocks(data, "<")
    if data[:4] not in MAGIC:
        raise ValueError("not a capture file")
    return _classic(data[24:], *MAGIC[data[:4]])


def _classic(data: bytes, order: str, unit: float) -> Iterator[tuple[float, int, bytes]]:
    at = 0
    while at + 16 <= len(data):
        seconds, part, kept, length = struct.unpack_from(f"{order}IIII", data, at)
        if at + 16 + kept > len(data):
            return
        yield seconds + part / unit, length, data[at + 16 : at + 16 + kept]
        at += 16 + kept


def _section_order(head: bytes) -> str:
    return "<" if head == b"\x4d\x3c\x2b\x1a" else ">"


def _blocks(data: bytes, order: str) -> Iterator[tuple[float, int, bytes]]:
    """Enhanced packet blocks of the newer format, with its default resolution of microseconds."""
    at = 0
    while at + 12 <= len(data):
        if data[at : at + 4] == PCAPNG:
            order = _section_order(data[at + 8 : at + 12])
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if size < 12 or at + size > len(data):
            return
        if kind == 6:
            high, low, kept, length = struct.unpack_from(f"{order}IIII", data, at + 12)
            yield ((high << 32) | low) / 1e6, length, data[at + 28 : at + 28 + kept]
        at += size


def ranges(stream, most: int | None = None, per_range: int = RANGE, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[str, float, int, int, int]]:
    """(byte order, unit of time or 0 for the newer format, begin, end, number of its first packet) of each range of a capture that
    is read once, as a stream.  A record that isn't complete ends it; most: packets at most."""
    head = stream.read(4)
    newer = head == PCAPNG
    if not newer and head not in MAGIC:
        raise ValueError("not a capture file")
    order, unit = ("<", 0.0) if newer else MAGIC[head]
    at = 0 if newer else 24
    if not newer:
        stream.read(20)
    begin, first, n, own = at, 0, 0, order  # own: the order in which the open range begins
    while most is None or n < most:
        if newer:
            raw = head if at == 0 else stream.read(4)
            rest = stream.read(8)
            if len(rest) < 8:
                break
            if raw == PCAPNG:
                order = _section_order(rest[4:])
            kind, size = struct.unpack(f"{order}II", raw + rest[:4])
            if size < 12 or len(stream.read(size - 12)) < size - 12:
                break
            packet = kind == 6
        else:
            raw = stream.read(16)
            if len(raw) < 16:
                break
            kept = struct.unpack_from(f"{order}I", raw, 8)[0]
            if len(stream.read(kept)) < kept:
                break
            size, packet = 16 + kept, True
        if at > begin and (n - first >= per_range or at + size - begin > range_bytes):
            yield own, unit, begin, at, first
            begin, first, own = at, n, order
        at, n = at + size, n + packet
    if at > begin:
        yield own, unit, begin, at, first


def _name(data: bytes) -> str | None:
    """The first question's name of a DNS message, without its final dot."""
    labels, at = [], 12
    while at < len(data) and data[at]:
        n = data[at]
        if n & 0xC0:
            return None
        labels.append(data[at + 1 : at + 1 + n].decode("utf-8", "ignore"))
        at += 1 + n
    return ".".join(labels) or None


def frame(data: bytes) -> dict | None:
    """The fields of an ARP, IPv4 or IPv6 frame; None for others."""
    if len(data) < 14:
        return None
    kind, body = struct.unpack_from("!H", data, 12)[0], data[14:]
    if kind == 0x8100 and len(body) >= 4:
        kind, body = struct.unpack_from("!H", body, 2)[0], body[4:]
    if kind == 0x0806 and len(body) >= 28:
        return {"src_ip": socket.inet_ntoa(body[14:18]), "dst_ip": socket.inet_ntoa(body[24:28]), "src_port": 0, "dst_port": 0, "proto": 2054, "tcp_flags": 0, "ihl": 0, "arp_op": struct.unpack_from("!H", body, 6)[0]}
    if kind == 0x0800 and len(body) >= 20:
        words, proto = body[0] & 15, body[9]
        out, rest = {"src_ip": socket.inet_ntoa(body[12:16]), "dst_ip": socket.inet_ntoa(body[16:20]), "proto": proto, "ihl": words}, body[words * 4 :]
    elif kind == 0x86DD and len(body) >= 40:
        out, rest = {"src_ip": socket.inet_ntop(socket.AF_INET6, body[8:24]), "dst_ip": socket.inet_ntop(socket.AF_INET6, body[24:40]), "proto": body[6], "ihl": 10}, body[40:]
    else:
        return None
    out |= {"src_port": 0, "dst_port": 0, "tcp_flags": 0}
    data_of = None
    if out["proto"] in (6, 17) and len(rest) >= 8:
        out["src_port"], out["dst_port"] = struct.unpack_from("!HH", rest)
        data_of = rest[8:] if out["proto"] == 17 else rest[(rest[12] >> 4) * 4 :] if len(rest) >= 20 else b""
    if out["proto"] == 6 and len(rest) >= 14:
        out["tcp_flags"] = rest[13]
    if out["proto"] in (1, 58) and rest:
        out["icmp_type"] = rest[0]
    if out["proto"] == 17 and 53 in (out["src_port"], out["dst_port"]) and len(rest) > 20:
        out["dns_qname"], out["dns_opcode"], out["dns_rcode"] = _name(rest[8:]), rest[10] >> 3 & 15, rest[11] & 15
    if data_of:
        out["payload"] = data_of.decode("latin-1")  # a character for each byte
        if found := _REQUEST.match(data_of):
            out["http_uri"] = found[1].decode("latin-1")
    return out


_REQUEST = re.compile(rb"(?:GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH) (\S+) HTTP/")


def _rows(found: Iterator[tuple[float, int, bytes]], first: int, most: int | None) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    for seq, (ts, length, data) in enumerate(found, first):
        if most is not None and seq >= most:
            break
        if fields := frame(data):
            fields |= {"ts": ts, "seq": seq, "frame_len": length}
            rows.append([fields.get(f) for f in _FIELDS])
        if len(rows) >= 5_000:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri("/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def read_packets(spark: SparkSession, path: str, max_packets: int | None = MAX_PACKETS, per_range: int = RANGE) -> DataFrame:
    """Packets of every capture under path; max_packets of each file, None for all.  Where only Spark's readers reach the files, each
    is one task."""
    files = spark.read.format("binaryFile").load(path)
    try:
        _opened(path)
    except (OSError, ValueError, NotImplementedError):
        return _read_whole(files, max_packets)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, place = _opened(name)
                with store.open_input_stream(place, buffer_size=1 << 22) as stream:
                    for found in ranges(stream, max_packets, per_range):
                        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, *found)], names=["path", "byte_order", "unit", "begin", "end", "first"])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, order, unit, begin, end, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, place = _opened(name)
                with store.open_input_file(place) as stream:
                    data = stream.read_at(end - begin, begin)
                yield from _rows(_classic(data, order, unit) if unit else _blocks(data, order), first, max_packets)

    listed = files.select("path").repartition("path").mapInArrow(index, "path string, byte_order string, unit double, begin long, end long, first long")
    return listed.repartition(2 * spark.sparkContext.defaultParallelism, "path", "begin").mapInArrow(parse, SCHEMA)


def _read_whole(files: DataFrame, max_packets: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _rows(records(content.as_py()), 0, max_packets)

    return files.select("content").mapInArrow(run, SCHEMA)


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_FIELDS)
