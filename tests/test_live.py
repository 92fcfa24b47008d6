"""Growing files as streams, ranges of captures, and sessions by a commit log."""

from __future__ import annotations

import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from packetloom.operators import rules
from packetloom.sources import captures, live
from packetloom.sources.session_store import SessionStore


def tcp(payload: bytes, flags: int, src: int = 1, dst: int = 2, ports: tuple[int, int] = (1111, 80)) -> bytes:
    body = struct.pack("!HHIIBBHHH", *ports, 0, 0, 5 << 4, flags, 0, 0, 0) + payload
    return _ip(6, body, src, dst)


def _ip(proto: int, body: bytes, src: int, dst: int) -> bytes:
    return b"\0" * 12 + b"\x08\x00" + struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, proto, 0, bytes([10, 0, 0, src]), bytes([10, 0, 0, dst])) + body


def dns(name: bytes, flags: int) -> bytes:
    message = struct.pack("!HHHHHH", 1, flags, 1, 1, 0, 0) + name + struct.pack("!HH", 1, 1)
    return _ip(17, struct.pack("!HHHH", 53, 5353, 8 + len(message), 0) + message, 2, 1)


def capture(frames, order: str = "<", nano: bool = False) -> bytes:
    magic = {("<", False): b"\xd4\xc3\xb2\xa1", (">", False): b"\xa1\xb2\xc3\xd4", ("<", True): b"\x4d\x3c\xb2\xa1"}[order, nano]
    head = magic + struct.pack(f"{order}HHiIII", 2, 4, 0, 0, 65535, 1)
    return head + b"".join(record(i, f, order, nano) for i, f in enumerate(frames))


def record(i: int, f: bytes, order: str = "<", nano: bool = False) -> bytes:
    return struct.pack(f"{order}IIII", 100 + i, i * (1000 if nano else 1), len(f), len(f)) + f


def newer(frames) -> bytes:
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))

    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    return out + b"".join(block(6, struct.pack("<IIIII", 0, 0, 1000 + i, len(f), len(f)) + f) for i, f in enumerate(frames))


FRAMES = [tcp(b"GET /login?x=1 HTTP/1.1\r\nHost: a", 24), tcp(b"", 2), dns(b"\x03www\x01a\x00", 0x8180), _ip(1, b"\x08\x00\0\0", 3, 4), b"short", tcp(b"y" * 900, 16)]


@pytest.mark.parametrize("data", [capture(FRAMES * 40), capture(FRAMES * 40, ">"), capture(FRAMES * 40, nano=True), newer(FRAMES * 40), capture(FRAMES * 40) + b"cut off", newer(FRAMES) + newer(FRAMES * 39)])
def test_ranges_hold_every_packet_once(data):
    whole = list(captures.records(data))
    assert len(whole) == 240
    for per_range, size in ((7, 10**6), (10**6, 2000), (1, 10**6), (10**6, 10**6)):
        found, first = [], []
        for order, unit, begin, end, n in captures.ranges(io.BytesIO(data), None, per_range, size):
            first.append(n)
            assert n == len(found)
            part = data[begin:end]
            found += captures._classic(part, order, unit) if unit else captures._blocks(part, order)
        assert found == whole
        assert len(first) == {7: 35, 1: 240}.get(per_range, 1) or size == 2000


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(capture(FRAMES * 100))
    df = captures.read_packets(spark, f"{tmp_path}/a.pcap", per_range=30).withColumn("task", F.spark_partition_id()).cache()
    assert df.count() == 500 and df.select("task").distinct().count() >= 4 and df.select("seq").distinct().count() == 500
    assert captures.read_packets(spark, f"{tmp_path}/a.pcap", max_packets=45, per_range=20).agg(F.max("seq")).first()[0] < 45
    whole = captures._read_whole(spark.read.format("binaryFile").load(f"{tmp_path}/a.pcap"), None)
    assert sorted(map(str, whole.collect())) == sorted(map(str, df.drop("task").collect()))
    row = {r["seq"]: r for r in df.where("seq < 6").collect()}
    assert row[0]["http_uri"] == "/login?x=1" and row[0]["payload"].startswith("GET") and row[1]["payload"] is None
    assert (row[2]["dns_qname"], row[2]["dns_opcode"], row[2]["dns_rcode"]) == ("www.a", 0, 0) and row[3]["icmp_type"] == 8 and 4 not in row


def test_rules_about_contents_apply_to_captures(spark, tmp_path):
    frames = [tcp(b"", 2, ports=(5, 4444)), tcp(b"", 0x12, 2, 1, (4444, 5)), tcp(b"", 16, ports=(5, 4444)), tcp(b"x METERPRETER", 24, ports=(5, 4444)), tcp(b"", 24, ports=(6, 4444)), tcp(b"GET /a/../../b HTTP/1.0\r\n", 24)]
    (tmp_path / "a.pcap").write_bytes(capture(frames + [_ip(1, b"\x08\x00\0\0", 3, 4)] * 45 + [dns(b"\x01a\x00", 0x8180)] * 12))
    packets = rules.with_established(captures.read_packets(spark, f"{tmp_path}/a.pcap"))
    found = {(r["sid"], r["seq"]) for r in rules.match_packets(packets).collect()}
    assert found == {(9000041, 2), (9000041, 3), (9000040, 3), (9000062, 5)}
    scaled = packets.withColumn("ts", F.lit(1.0))
    assert {(r["sid"], r["address"], r["hits"]) for r in rules.alert_once(scaled).collect()} == {(9000022, "10.0.0.4", 45), (9000070, "10.0.0.1", 12), (9000071, "10.0.0.2", 12)}


def _collect(stream, folder):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/check").option("path", f"{folder}/out").trigger(once=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.read.parquet(f"{folder}/out")


def test_growing_lines_are_read_once(spark, tmp_path, monkeypatch):
    spark.dataSource.register(live.LineTail)
    (tmp_path / "in").mkdir()
    log = tmp_path / "in" / "eve.json"
    rng = random.Random(1)
    lines = [f"line {i} " + "x" * rng.randrange(200) + rng.choice(["", "é", " "]) for i in range(3000)]
    text = "".join(x + "\n" for x in lines).encode()
    at = 0
    for upto in (5, 70_000, 70_001, 200_000, len(text)):  # in the middle of lines; the query starts anew each time
        with log.open("ab") as f:
            f.write(text[at:upto])
        at = upto
        out = _collect(spark.readStream.format("line_tail").option("path", f"{tmp_path}/in").load(), tmp_path)
        assert out.count() == text[:upto].count(b"\n")
    (tmp_path / "in" / "other.json").write_text("new\nnot whole")
    out = _collect(spark.readStream.format("line_tail").option("path", f"{tmp_path}/in").load(), tmp_path)
    assert sorted(r["value"] for r in out.collect()) == sorted([*lines, "new"])


def test_growing_captures_are_read_once(spark, tmp_path):
    spark.dataSource.register(live.PacketTail)
    (tmp_path / "in").mkdir()
    data, at = capture(FRAMES * 50), 0
    for upto in (10, 24, 500, 20_000, len(data)):
        with (tmp_path / "in" / "a.pcap").open("ab") as f:
            f.write(data[at:upto])
        at = upto
        out = _collect(spark.readStream.format("packet_tail").option("path", f"{tmp_path}/in").load(), tmp_path)
    assert out.count() == 250 and out.select("seq").distinct().count() == 250


def test_ranges_of_a_growing_file(tmp_path, monkeypatch):
    monkeypatch.setattr(live, "PART_BYTES", 50)
    text = b"".join(b"x" * n + b"\n" for n in (3, 200, 0, 10, 60, 49, 48, 1))
    (tmp_path / "a").write_bytes(text + b"rest")
    reader = live._LineReader(str(tmp_path / "a"))
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert list(end.values()) == [len(text)] and [p.begin for p in parts[1:]] == [p.end for p in parts[:-1]]
    assert [x for p in parts for (x,) in reader.read(p)] == text.decode().split("\n")[:-1]
    (tmp_path / "a").write_bytes(b"new\n")  # rotated
    assert [x for p in reader.partitions(end, reader.latestOffset()) for (x,) in reader.read(p)] == ["new"]


def test_sessions_are_inserted_as_a_whole(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path))
    flows = spark.createDataFrame([("a", "b", 0, "TCP", 0.5), ("a", "c", 5, "UDP", 0.9)], "src_ip string, dst_ip string, canonical_id int, proto string, confidence double")
    alerts = spark.createDataFrame([("ALT-1", "x")], "alert_id string, engine string")
    store.create("one", flows, alerts)
    store.write("lost", flows, alerts)  # ends before its commit
    assert [r["session_id"] for r in store.list().collect()] == ["one"] and store.read("session_flows").count() == 2 and store.get("lost").count() == 0
    store.create("one", flows, alerts)
    second = store.write("one", flows, alerts)
    store.commit("one", second)  # two writers at once
    assert store.read("session_flows").count() == 2 and store.read("session_alerts").count() == 1
    row = store.get("one").first()
    assert len(row["flows"]) == 2 and len(row["alerts"]) == 1
    store.create("two", flows, alerts)
    assert store.list().count() == 2 and store.latest().count() == 1
    store.purge()
    assert store.list().count() == 0 and store.read("session_alerts").count() == 0
