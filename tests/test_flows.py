from __future__ import annotations

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from packetloom.operators import eve, flows, rules, sessions
from packetloom.sources import captures

PACKET = "ts double, seq long, src_ip string, dst_ip string, src_port int, dst_port int, proto int, frame_len int, tcp_flags int, ihl int, arp_op int, dns_qname string"


def packets(spark, rows):
    full = [(t, i, a, b, p, q, proto, n, f, 5, None, None) for i, (t, a, b, p, q, proto, n, f) in enumerate(rows)]
    return spark.createDataFrame(full, PACKET)


def test_two_way(spark):
    df = packets(spark, [(0.0, "A", "B", 1234, 80, 6, 100, 2), (1.0, "B", "A", 80, 1234, 6, 200, 18), (2.0, "A", "B", 1234, 80, 6, 100, 16), (4.0, "B", "A", 80, 1234, 6, 400, 16)])
    row = flows.pcap_flows(df).collect()
    assert len(row) == 1
    r = row[0]
    assert (r["flow_duration"], r["Rate"], r["Srate"], r["Drate"]) == (4.0, 200.0, 0.5, 0.5)
    assert r["IAT"] == pytest.approx(4 / 3) and r["HTTP"] == 1.0 and r["syn_count"] == 2.0 and r["Number"] == 4.0 and r["src_ip"] == "A"


def test_single_packet(spark):
    df = packets(spark, [(5.0, "B", "A", 1, 2, 17, 60, 0)])
    r = flows.pcap_flows(df).first()
    assert (r["Rate"], r["Srate"], r["Drate"], r["Std"], r["IAT"]) == (60.0, 0.0, 1.0, 0.0, 0.0)
    live = flows.live_flows(df).first()
    assert live["flow_duration"] == 0.0001 and live["Rate"] == 10000.0 and live["Srate"] == 10000.0 and live["Header_Length"] == 20.0


def test_text_order_of_addresses(spark):
    r = flows.with_flow_key(packets(spark, [(0.0, "10.0.0.9", "10.0.0.10", 1, 2, 6, 60, 0)])).first()
    assert r["ip_a"] == "10.0.0.10" and not r["is_fwd"]


def test_arp(spark):
    df = spark.createDataFrame([(0.0, 0, "A", "B", 0, 0, 2054, 42, 0, 0, 1, None), (1.0, 1, "A", "B", 0, 0, 2054, 42, 0, 0, 2, None), (2.0, 2, "C", "C", 0, 0, 2054, 42, 0, 0, 1, None)], PACKET)
    by = {r["src_ip"]: r for r in flows.pcap_flows(df).collect()}
    assert by["A"]["Drate"] == 2.0 and by["A"]["Srate"] == 0.0 and by["A"]["arp_opcode"] == 1.0 and by["A"]["ARP"] == 1.0
    assert [r["is_anomaly"] for r in flows.arp_events(df).orderBy("seq").collect()] == [False, True, True]
    assert flows.live_flows(df).count() == 0


def test_idle_gap_and_cap(spark):
    one = lambda t: (t, "A", "B", 1, 2, 6, 60, 0)
    assert flows.live_flows(packets(spark, [one(0.0), one(4.9)])).count() == 1
    assert flows.live_flows(packets(spark, [one(0.0), one(5.0)])).count() == 2
    assert flows.live_flows(packets(spark, [one(0.0), one(5.1)])).count() == 2
    assert sorted(r["packet_count"] for r in flows.live_flows(packets(spark, [one(i / 1000) for i in range(101)])).collect()) == [1, 100]


def test_eve_lines(spark):
    record = lambda **x: json.dumps(x)
    lines = [record(event_type=t, flow_id=1) for t in eve.EVENT_TYPES] + ["", "  ", "{broken", record(event_type="stats"), record(event_type="alert") + "}{"]
    parsed = eve.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    s = eve.summary(parsed).first()
    assert (s["total_records"], s["corrupt_records"], s["alert_count"], s["tls_count"]) == (7, 2, 1, 1)
    alert = eve.events(parsed, "alert").first()
    assert (alert["action"], alert["gid"], alert["severity"], alert["sid"], alert["metadata"], alert["signature"]) == ("allowed", 1, 3, None, {}, "Unknown Signature")
    assert eve.events(parsed, "flow").first()["pkts_toserver"] == 0
    for kind in eve.EVENT_TYPES:
        assert eve.events(parsed, kind).count() == 1


@pytest.mark.parametrize(("sid", "signature", "expected"), [(9000050, "x", 5), (None, "brute force login", 6), (None, "arp poison", 7), (None, "c2 beacon", 4), (None, "nmap scan", 10), (None, "hello", None), (None, None, None)])
def test_alert_mapping(spark, sid, signature, expected):
    r = eve.map_alerts(spark.createDataFrame([(sid, signature, None)], "sid int, signature string, category string")).first()
    assert r["canonical_id"] == expected
    assert r["canonical_class"] == ("Unmapped Alert" if expected is None else eve.CLASSES[expected])


def test_correlation(spark):
    ours = spark.createDataFrame([("A", "B", 1, 80, 6, 3), ("C", "D", 1, 80, 6, 0), ("E", "F", 1, 80, 17, 2), ("G", "H", 1, 1, 6, 0)], "src_ip string, dst_ip string, src_port int, dst_port int, proto int, canonical_id int")
    alerts = spark.createDataFrame([("B", "A", 80, 1, "TCP"), ("C", "D", 1, 80, "tcp"), ("E", "F", 1, 80, "TCP"), ("B", "A", 80, 1, "TCP")], "src_ip string, dest_ip string, src_port int, dest_port int, proto string")
    assert eve.correlation_counts(eve.correlate(ours, alerts)).first().asDict() == {"both_threat": 1, "ai_only": 1, "signature_only": 1, "both_benign": 1}


def test_distribution_has_all_classes(spark):
    out = eve.full_distribution(spark.createDataFrame([(1,), (1,), (None,)], "canonical_id int"))
    counts = {r["class_name"]: r["n"] for r in out.collect()}
    assert len(counts) == 14 and counts["DDoS"] == 2 and counts["Unmapped Alert"] == 1 and counts["MITM"] == 0


def test_rules(spark):
    assert len(rules.rules()) == 32 and len({r.sid for r in rules.rules()}) == 32
    assert {r.class_id for r in rules.rules()} == set(range(1, 13)) - {9}
    burst = packets(spark, [(i / 100, "S", "T", 4000 + i, 22, 6, 60, 2) for i in range(60)])
    found = {(r["sid"], r["address"]) for r in rules.rate_alerts(burst).collect()}
    assert {(9000010, "T"), (9000050, "S"), (9000103, "S")} <= found and (9000020, "S") not in found
    odd = packets(spark, [(0.0, "S", "S", 1, 4444, 6, 60, 41), (1.0, "127.0.0.1", "T", 1, 2, 6, 60, 0)])
    assert {r["sid"] for r in rules.match_packets(odd).collect()} == {9000080, 9000081, 9000100, 9000101}
    assert 9000041 in {r["sid"] for r in rules.match_packets(odd.withColumn("established", F.lit(True))).collect()}
    content = odd.withColumns({"payload": F.lit("x MIRAI y"), "http_uri": F.lit("/?q=union select"), "dst_port": F.lit(23)})
    assert {9000031, 9000060} <= {r["sid"] for r in rules.match_packets(content).collect()}
    assert rules.rule_lines(spark.createDataFrame([("# c",), ("",), ("alert x",)], "value string")).first()["n_rules"] == 1


def intervals(times, count, seconds):
    """Start, alert and hits of the intervals of one address that reach the count, one after the other."""
    out, left = [], sorted(times)
    while left:
        inside = [x for x in left if x < left[0] + seconds]
        if len(inside) >= count:
            out.append((inside[0], inside[count - 1], len(inside)))
        left = left[len(inside) :]
    return out


def test_one_alert_for_each_interval(spark):
    rng = random.Random(2)
    times = {a: [round(rng.uniform(0, 900) ** rng.choice([1, 0.7]), 1) for _ in range(n)] for a, n in (("A", 2000), ("B", 300), ("C", 40), ("D", 1))}
    df = packets(spark, [(t, "S", a, 1, 80, 6, 60, 2) for a, ts in times.items() for t in ts])
    for count, seconds in ((3, 1), (10, 5), (2, 60)):
        found = rules.alert_once(df, sids=(9000010,), scale=(count, seconds)).collect()
        got = sorted((r["address"], r["interval_start"], r["alert_at"], r["hits"]) for r in found)
        assert got == sorted((a, *x) for a, ts in times.items() for x in intervals(ts, count, seconds))
    assert rules.alert_once(df.limit(0)).count() == 0


def test_sliding_counts_do_not_depend_on_buckets(spark):
    rng = random.Random(3)
    rows = [(round(rng.uniform(0, 500), 1), rng.choice("AB"), "T", 1, 80, 6, 60, 2) for _ in range(800)]
    found = rules.sliding_rate(packets(spark, rows), F.col("tcp_flags") == 2, "src_ip", 4, 5).collect()
    counts = {i: sum(a == b and s - 5 <= t <= s for t, b, *_ in rows) for i, (s, a, *_) in enumerate(rows)}
    assert {r["seq"]: r["hits"] for r in found} == {i: n for i, n in counts.items() if n >= 4}


def test_handshakes(spark):
    a, b = ("A", "B", 5, 80), ("B", "A", 80, 5)
    rows = [(1.0, *a, 6, 60, 2), (2.0, *a, 6, 60, 16), (3.0, *b, 6, 60, 0x12), (3.0, *b, 6, 60, 16), (4.0, *a, 6, 60, 16), (5.0, *b, 6, 60, 24), (6.0, *a, 17, 60, 0)]
    never = [(1.0, "C", "D", 1, 2, 6, 60, 2), (2.0, "C", "D", 1, 2, 6, 60, 0x12), (3.0, "C", "D", 1, 2, 6, 60, 16), (1.0, "E", "F", 1, 2, 6, 60, 0x12), (2.0, "F", "E", 2, 1, 6, 60, 2), (3.0, "F", "E", 2, 1, 6, 60, 16)]
    found = {r["seq"] for r in rules.with_established(packets(spark, rows + never)).where("established").collect()}
    assert found == {4, 5}


def test_capture_file(spark, tmp_path):
    dns = struct.pack("!HHHHHH", 1, 256, 1, 0, 0, 0) + b"\x03www\x06google\x03com\x00" + struct.pack("!HH", 1, 1)
    udp = struct.pack("!HHHH", 5353, 53, 8 + len(dns), 0) + dns
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(udp), 0, 0, 64, 17, 0, bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2])) + udp
    arp = b"\0" * 12 + struct.pack("!H", 0x0806) + struct.pack("!HHBBH", 1, 2048, 6, 4, 2) + b"\1" * 6 + bytes([10, 0, 0, 3]) + b"\2" * 6 + bytes([10, 0, 0, 4])
    frames = [b"\0" * 12 + struct.pack("!H", 0x0800) + ip, arp]
    data = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, x in enumerate(frames):
        data += struct.pack("<IIII", 100 + i, 500_000, len(x), len(x)) + x
    (tmp_path / "a.pcap").write_bytes(data)
    rows = captures.read_packets(spark, str(tmp_path)).orderBy("seq").collect()
    assert rows[0]["dns_qname"] == "www.google.com" and rows[0]["ts"] == 100.5 and rows[0]["dst_port"] == 53
    assert rows[1]["proto"] == 2054 and rows[1]["arp_op"] == 2 and rows[1]["src_ip"] == "10.0.0.3"
    assert captures.read_packets(spark, str(tmp_path), 1).count() == 1
    (tmp_path / "b.pcap").write_bytes(b"junk")
    with pytest.raises(Exception, match="not a capture"):
        captures.read_packets(spark, str(tmp_path)).count()


def test_unmapped_alerts_are_kept(spark):
    flow = sessions.judged(spark.createDataFrame([("s", None)], "session string, canonical_id int")).first()
    assert flow["class_name"] == "Unmapped Alert"


def test_session_store(spark, tmp_path):
    from packetloom.sources.session_store import SessionStore

    store = SessionStore(spark, str(tmp_path))
    ours = spark.createDataFrame([("A", "B", 0, "TCP"), ("C", "D", 3, "UDP")], "src_ip string, dst_ip string, canonical_id int, proto string")
    alerts = spark.createDataFrame([("ALT-1", "High")], "alert_id string, severity string")
    store.create("SES-1", ours, alerts)
    row = store.get("SES-1").first()
    assert row["total_flows"] == 2 and row["detection_rate"] == 50.0 and [f["flow_index"] for f in row["flows"]] == [1, 2] and len(row["alerts"]) == 1
    assert store.latest().first()["session_id"] == "SES-1" and store.list().count() == 1
    store.purge()
    assert store.read("sessions").count() == 0
