from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom import streaming
from packetloom.operators import flows, rules

from .test_flows import PACKET


def _packets(spark, path):
    rows = [(t, i, *(("A", "B", 1, 22) if i % 2 else ("B", "A", 22, 1)), 6, 60, 2, 5, None, None) for i, t in enumerate([1000.0, 1001.0, 1002.0, 1020.0, 1021.0, 1100.0])]
    df = spark.createDataFrame(rows, PACKET)
    df.coalesce(1).write.mode("overwrite").parquet(path)  # arrival order is time order
    return df


def _run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_session_windows(spark, tmp_path):
    df = _packets(spark, f"{tmp_path}/p")
    out = _run(streaming.session_flows(streaming.packet_stream(spark, f"{tmp_path}/p", df.schema)), "windows").collect()
    assert sorted(r["packet_count"] for r in out) == [2, 3]  # the last session is still open


def test_capped_flows_match_batch(spark, tmp_path):
    df = _packets(spark, f"{tmp_path}/p")
    out = _run(streaming.capped_flows(streaming.packet_stream(spark, f"{tmp_path}/p", df.schema)), "capped").collect()
    batch = {(r["packet_count"], r["start_time"]) for r in flows.live_flows(df).collect()}
    found = {(r["packet_count"], r["start_time"]) for r in out}
    assert found <= batch and len(found) >= 2, (found, batch)


def test_packets_out_of_order_match_batch(spark, tmp_path):
    """Micro-batches of shuffled packets, within the watermark's delay, give the flows of the batch twin."""
    rng = random.Random(1)
    times = []
    at = 1000.0
    for i in range(700):
        at += rng.choice([0.0, 0.01, 0.01, 0.02, 0.4]) if i % 60 else rng.choice([4.9, 5.0, 7.0])
        times.append(round(at, 2))
    ends = lambda i: (("A", "B", 1, 22), ("B", "A", 22, 1), ("C", "B", 5, 80))[i % 5 % 3]
    rows = [(t, i, *ends(i), 6, 60 + i % 7, 2, 5, None, None) for i, t in enumerate(times)] + [(t + 500, 9000 + k, "Z", "Y", 1, 1, 6, 60, 2, 5, None, None) for k, t in enumerate([at, at])]
    arrival = sorted(rows[:-2], key=lambda r: r[0] + rng.random() * 8) + rows[-2:]  # up to 8 of 10 seconds late
    for k in range(0, len(arrival), 90):
        spark.createDataFrame(arrival[k : k + 90], PACKET).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
        time.sleep(0.05)  # files are read in the order of their times
    df = spark.createDataFrame(rows[:-2], PACKET)
    stream = streaming.packet_stream(spark, f"{tmp_path}/p", df.schema, files_per_trigger=1)
    found = sorted((r["packet_count"], r["byte_count"], r["start_time"], r["end_time"]) for r in _run(streaming.capped_flows(stream), "disordered").collect())
    batch = sorted((r["packet_count"], r["byte_count"], r["start_time"], r["end_time"]) for r in flows.live_flows(df).collect())
    assert found == batch and max(f[0] for f in found) == flows.MAX_PACKETS


@pytest.mark.parametrize("cap", [3, 100])
def test_flows_are_cut_as_row_by_row(cap):
    rng = np.random.default_rng(cap)
    for _ in range(50):
        ts = np.sort(rng.integers(0, 60, rng.integers(1, 40)).astype(float))
        n, last = (0, None) if rng.random() < 0.3 else (int(rng.integers(1, cap + 1)), float(ts[0] - rng.integers(0, 8)))
        want, end, count = [], last, n
        for i, t in enumerate(ts):
            if not count or t - end >= 5 or count >= cap:
                want.append(i)
                count = 0
            end, count = t, count + 1
        assert streaming.cut_flows(ts, 5, cap, n, last).tolist() == want


def test_rates(spark, tmp_path):
    df = _packets(spark, f"{tmp_path}/p")
    rule = rules.Rule(1, 5, F.col("tcp_flags") == 2, by="dst_ip", count=1, seconds=5)
    out = _run(streaming.rate_alerts(streaming.packet_stream(spark, f"{tmp_path}/p", df.schema), rule), "rates").collect()
    assert {r["address"] for r in out} == {"A", "B"}


def test_ingest_and_delivery(spark, tmp_path):
    records = spark.createDataFrame([(1, {"query_length": 1.0, "entropy": 2.0}), (2, {"query_length": 1.0}), (3, {"zzz": 1.0})], "id int, features map<string,double>")
    scorers = {"DNS_Tunneling": lambda df: df.withColumns({"canonical_id": F.lit(12), "confidence": F.lit(0.9)})}
    needs = {"DNS_Tunneling": ("query_length", "entropy")}
    status = {r["id"]: r["status"] for r in streaming.ingest(records, scorers, needs).collect()}
    assert status == {1: "OK", 2: "INCOMPLETE_FEATURES", 3: "UNROUTED"}
    records.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(records.schema).parquet(f"{tmp_path}/in")
    query = streaming.deliver(stream, f"{tmp_path}/out", f"{tmp_path}/check", scorers, needs, once=True)
    query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_dns_events(spark):
    df = spark.createDataFrame([(0.0, 0, "A", "B", 5, 53, 17, 60, 0, 5, None, "www.google.com")], PACKET)
    assert streaming.dns_events(df).first()["num_dots"] == 2


def test_events_that_are_not_accepted_are_sent_again(spark, tmp_path):
    log, up = tmp_path / "log", tmp_path / "up"

    def send(payload):
        with log.open("a") as f:
            f.write("".join(f"{e['n']} {up.exists()}\n" for e in payload["events"]))
        return 200 if up.exists() or payload["events"][0]["n"] % 2 else 503

    (tmp_path / "in").mkdir()
    stream = spark.readStream.text(f"{tmp_path}/in")
    for k in range(2):
        spark.range(k * 4, k * 4 + 4).selectExpr("to_json(struct(id AS n)) AS value").coalesce(1).write.mode("append").text(f"{tmp_path}/in")
        query = streaming.post(stream, send, "s1", f"{tmp_path}/requeue", f"{tmp_path}/check", size=1, once=True)
        query.awaitTermination(120)
        assert query.exception() is None
        left = {r["value"] for r in spark.read.parquet(f"{tmp_path}/requeue/batch={k}").collect()}
        assert left == ({'{"n":0}', '{"n":2}'} if k == 0 else set())
        up.touch()
    accepted = [line.split()[0] for line in log.read_text().splitlines() if line.endswith("True") or int(line.split()[0]) % 2]
    assert sorted(map(int, accepted)) == list(range(8))
