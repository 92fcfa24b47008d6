"""Signature rules as declarative predicates over packets, their rates in tumbling or sliding windows or in intervals, and the
connections whose handshake is complete."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .flows import with_flow_key

SYN, RST, XMAS, SYN_FIN = 0x02, 0x04, 0x29, 0x03


@dataclass(frozen=True)
class Rule:
    """needs: optional columns without which the rule doesn't apply; by, count, seconds: a rate by address."""

    sid: int
    class_id: int
    predicate: Column | None = field(repr=False, compare=False)
    needs: tuple[str, ...] = ()
    by: str | None = None
    count: int = 1
    seconds: int = 1


def _has(column: str, *texts: str, nocase: bool = False) -> Column:
    c, out = F.lower(column) if nocase else F.col(column), F.lit(True)
    for t in texts:
        out = out & c.contains(t.lower() if nocase else t)
    return out


def _at(column: str, text: str, offset: int) -> Column:
    """Whether a text stands at a place of a column, characters being bytes."""
    return F.substring(column, offset + 1, len(text)) == text


def rules() -> list[Rule]:
    """All 32 rules.  --- fixed values: ids, classes, thresholds, patterns ---"""
    tcp, udp, icmp = (F.col("proto") == p for p in (6, 17, 1))
    flags, src_port, dst_port = F.col("tcp_flags").bitwiseAND(63), F.col("src_port"), F.col("dst_port")
    dns_to = dst_port == 53
    web, open_ = F.col("http_uri").isNotNull(), F.col("established")
    return [
        Rule(9000010, 1, tcp & (flags == SYN), by="dst_ip", count=50, seconds=1),
        Rule(9000011, 1, udp & (src_port == 123) & _at("payload", "\x17\x00\x03\x2a", 0), ("payload",)),
        Rule(9000012, 1, udp & (src_port == 1900) & _has("payload", "HTTP/1.1 200 OK"), ("payload",)),
        Rule(9000020, 2, tcp & (flags == RST), by="src_ip", count=30, seconds=1),
        Rule(9000021, 2, tcp & (dst_port == 80) & _has("payload", "POST", "Content-Length: 1000000"), ("payload",)),
        Rule(9000022, 2, icmp & (F.col("icmp_type") == 8), ("icmp_type",), by="dst_ip", count=40, seconds=1),
        Rule(9000030, 3, tcp & (dst_port == 6667) & _has("payload", "NICK ", "JOIN #"), ("payload",)),
        Rule(9000031, 3, tcp & dst_port.isin(23, 2323) & _has("payload", "mirai", nocase=True), ("payload",)),
        Rule(9000032, 3, _has("http_uri", "/submit.php?id=") & _has("payload", "User-Agent: Mozi"), ("http_uri", "payload")),
        Rule(9000040, 4, tcp & open_ & _has("payload", "meterpreter", nocase=True), ("payload", "established")),
        Rule(9000041, 4, tcp & open_ & (dst_port == 4444), ("established",)),
        Rule(9000042, 4, tcp & open_ & _has("payload", "powershell -enc ", nocase=True), ("payload", "established")),
        Rule(9000050, 5, tcp & (dst_port == 22) & (flags == SYN), by="src_ip", count=10, seconds=5),
        Rule(9000051, 5, tcp & (dst_port == 21) & _has("payload", "USER ", "PASS "), ("payload",), by="src_ip", count=8, seconds=5),
        Rule(9000052, 5, web & _has("http_uri", "/login") & _has("payload", "POST"), ("http_uri", "payload"), by="src_ip", count=10, seconds=5),
        Rule(9000060, 6, _has("http_uri", "UNION", "SELECT", nocase=True), ("http_uri",)),
        Rule(9000061, 6, _has("http_uri", "<script>", nocase=True), ("http_uri",)),
        Rule(9000062, 6, _has("http_uri", "/../../"), ("http_uri",)),
        Rule(9000070, 7, (src_port == 53) & (F.col("dns_opcode") == 0) & (F.col("dns_rcode") == 0), ("dns_opcode", "dns_rcode"), by="dst_ip", count=5, seconds=2),
        Rule(9000071, 7, udp & (src_port == 53) & _at("payload", "\x81\x80", 2) & _at("payload", "\x00\x01\x00\x01", 4), ("payload",), by="src_ip", count=10, seconds=1),
        Rule(9000080, 8, F.col("src_ip") == F.col("dst_ip")),
        Rule(9000081, 8, F.col("src_ip").startswith("127.")),
        Rule(9000082, 8, F.col("src_ip") == "0.0.0.0"),
        Rule(9000100, 10, tcp & (flags == XMAS)),
        Rule(9000101, 10, tcp & (flags == 0)),
        Rule(9000102, 10, tcp & (flags == SYN_FIN)),
        Rule(9000103, 10, tcp & (flags == SYN), by="src_ip", count=25, seconds=3),
        Rule(9000110, 11, _has("payload", "Upgrade-Insecure-Requests: 0"), ("payload",)),
        Rule(9000111, 11, _has("tls_issuer", "portswigger", nocase=True), ("tls_issuer",)),
        Rule(9000120, 12, dns_to & F.col("dns_qname").rlike(r"^[a-zA-Z0-9_-]{45,}\."), ("dns_qname",)),
        Rule(9000121, 12, dns_to & _has("dns_qname", "tunnel", nocase=True), ("dns_qname",)),
        Rule(9000122, 12, dns_to & F.col("dns_qname").rlike(r"([a-zA-Z0-9+/]{16,}\.){2,}"), ("dns_qname",)),
    ]


def applicable(packets: DataFrame) -> list[Rule]:
    return [r for r in rules() if set(r.needs) <= set(packets.columns)]


def match_packets(packets: DataFrame, sids: tuple[int, ...] | None = None) -> DataFrame:
    """packets x the rules without a rate that they match: the packet's columns, sid, class_id.  One scan."""
    own = [r for r in applicable(packets) if r.by is None and (sids is None or r.sid in sids)]
    hits = F.array(*[F.when(F.coalesce(r.predicate, F.lit(False)), F.struct(F.lit(r.sid).alias("sid"), F.lit(r.class_id).alias("class_id"))) for r in own])
    return packets.select("*", F.inline(F.filter(hits, lambda h: h.isNotNull())))


def matching(packets: DataFrame, ts: str = "ts", sids: tuple[int, ...] | None = None, scale: tuple[int, int] | None = None) -> DataFrame:
    """sid, class_id, address, least, seconds, ts of the packets that a rate rule counts; one scan for all rules."""
    hits = []
    for r in (r for r in applicable(packets) if r.by is not None and (sids is None or r.sid in sids)):
        count, seconds = scale or (r.count, r.seconds)
        hit = F.struct(F.lit(r.sid).alias("sid"), F.lit(r.class_id).alias("class_id"), F.col(r.by).alias("address"), F.lit(count).alias("least"), F.lit(float(seconds)).alias("seconds"), F.col(ts).cast("double").alias("ts"))
        hits.append(F.when(F.coalesce(r.predicate, F.lit(False)), hit))
    return packets.where(F.col(ts).isNotNull()).select(F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))


def rate_alerts(packets: DataFrame, ts: str = "ts", sids: tuple[int, ...] | None = None, scale: tuple[int, int] | None = None) -> DataFrame:
    """sid, class_id, address, window_start, hits: one alert for each address and tumbling window that reaches a rule's
    count.  scale: (count, seconds) instead of the rules' own, for sparse traffic."""
    start = (F.floor(F.col("ts") / F.col("seconds")) * F.col("seconds")).cast("long").alias("window_start")
    counted = matching(packets, ts, sids, scale).groupBy("sid", "class_id", "address", start, "least").agg(F.count(F.lit(1)).alias("hits"))
    return counted.where(F.col("hits") >= F.col("least")).drop("least")


#: Lengths of time buckets, in windows of the rate: of buckets whose rows also count in the next one, and of those for intervals.
SLIDING_BUCKET, INTERVAL_BUCKET = 4, 16


def sliding_rate(packets: DataFrame, condition: Column, by: str, count: int, seconds: float, ts: str = "ts") -> DataFrame:
    """Packets at which the last seconds hold count matching packets of an address; a packet without time is none.

    An address is split into time buckets that overlap by the window: what lies in a bucket's last seconds is dealt to the
    next one, too, where it only counts.  So a busy address is as many groups as it has buckets."""
    length = SLIDING_BUCKET * seconds
    bucket = F.floor(F.col(ts) / length)
    to_next = (bucket + 1) * length - F.col(ts) <= seconds * 1.001  # a little more does no harm: the window leaves it out
    dealt = packets.where(condition & F.col(ts).isNotNull()).withColumn("_bucket", F.explode(F.when(to_next, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))))
    span = Window.partitionBy(by, "_bucket").orderBy(ts).rangeBetween(-seconds, 0)
    counted = dealt.withColumn("hits", F.count(F.lit(1)).over(span))
    return counted.where((F.col("hits") >= count) & (F.col("_bucket") == bucket)).drop("_bucket")


_ADDRESS = ("sid", "class_id", "address", "least", "seconds")
_ADDRESS_DDL = "sid int, class_id int, address string, least int, seconds double, bucket long"


def _next_starts(t: np.ndarray, seconds: float) -> np.ndarray:
    """For an interval that begins at each of the sorted times, the first time that no longer belongs to it."""
    return np.searchsorted(t, t + seconds, "left")


def _exits(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: the times at which its first interval may begin, and for each when the last one then ends."""
    seconds, bucket = float(key[4]), int(key[5])
    t = np.sort(rows["ts"].to_numpy()[rows["own"].to_numpy()])
    after = _next_starts(t, seconds)
    ends = np.append(t + seconds, 0.0)
    for i in range(len(t) - 1, -1, -1):
        if after[i] < len(t):
            ends[i] = ends[after[i]]
    n = min(len(t), int(np.searchsorted(t, (bucket * INTERVAL_BUCKET + 1) * seconds, "left")) + 1)
    return pd.DataFrame([(*key, t[:n], ends[:n])], columns=[*_ADDRESS, "bucket", "starts", "ends"])


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """When the first interval of each bucket begins, given when the last one of the bucket before it ends; an address's
    buckets come in order."""
    address, end = None, float("-inf")
    for rows in batches:
        out = []
        for r in rows.itertuples(index=False):
            if r[:5] != address:
                address, end = r[:5], float("-inf")
            at = int(np.searchsorted(r.starts, end, "left"))
            if at < len(r.starts):
                out.append((*r[:6], float(r.starts[at])))
                end = float(r.ends[at])
        yield pd.DataFrame(out, columns=[*_ADDRESS, "bucket", "start"])


def _alerts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The intervals of a bucket that reach the count."""
    least, seconds = int(key[3]), float(key[4])
    every = np.sort(rows["ts"].to_numpy())
    t, start, out = np.sort(rows["ts"].to_numpy()[rows["own"].to_numpy()]), rows["start"].iloc[0], []
    after = _next_starts(t, seconds)
    i = int(np.searchsorted(t, start, "left"))
    while i < len(t):
        first = int(np.searchsorted(every, t[i], "left"))
        hits = int(np.searchsorted(every, t[i] + seconds, "left")) - first
        if hits >= least:
            out.append((*key[:3], t[i], every[first + least - 1], hits))
        i = int(after[i])
    return pd.DataFrame(out, columns=["sid", "class_id", "address", "interval_start", "alert_at", "hits"])


def alert_once(packets: DataFrame, ts: str = "ts", sids: tuple[int, ...] | None = None, scale: tuple[int, int] | None = None) -> DataFrame:
    """sid, class_id, address, interval_start, alert_at, hits: the rate rules with one alert for each interval.  An interval
    begins with the first matching packet after the one before it has ended, lasts the rule's seconds, and alerts once, when it
    reaches the rule's count.

    Intervals of an address follow from each other.  Its packets are dealt to time buckets; each bucket says for every time
    at which its first interval may begin when its last one ends; only these tables pass through an address's buckets in order."""
    each = matching(packets, ts, sids, scale)
    length = INTERVAL_BUCKET * F.col("seconds")
    bucket = F.floor(F.col("ts") / length)
    ahead = F.col("ts") - bucket * length <= F.col("seconds") * 1.001  # an interval of the bucket before may reach here
    dealt = each.withColumn("bucket", F.explode(F.when(ahead, F.array(bucket - 1, bucket)).otherwise(F.array(bucket)))).withColumn("own", F.col("bucket") == bucket)
    dealt = dealt.select(*_ADDRESS, "bucket", "ts", "own")
    tables = dealt.groupBy(*_ADDRESS, "bucket").applyInPandas(_exits, f"{_ADDRESS_DDL}, starts array<double>, ends array<double>").where(F.size("starts") > 0)
    starts = tables.repartition(*_ADDRESS).sortWithinPartitions(*_ADDRESS, "bucket").mapInPandas(_chain, f"{_ADDRESS_DDL}, start double")
    begun = dealt.join(starts, [*_ADDRESS, "bucket"])
    return begun.groupBy(*_ADDRESS, "bucket").applyInPandas(_alerts, "sid int, class_id int, address string, interval_start double, alert_at double, hits long")


# --- established connections ------------------------------------------------------------------------
_CONNECTION = ("ip_a", "ip_b", "port_a", "port_b")


def handshakes(packets: DataFrame, ts: str = "ts", order: str = "seq") -> DataFrame:
    """ip_a, ip_b, port_a, port_b, established: when each connection's handshake is complete: SYN, then SYN/ACK from the other
    side, then ACK from the first.  Three small aggregates; nothing orders a connection's packets, however many it has."""
    flags = F.col("tcp_flags").bitwiseAND(0x17)  # FIN, SYN, RST, ACK
    tcp = with_flow_key(packets.where((F.col("proto") == 6) & (flags.isin(0x02, 0x12, 0x10)))).select(*_CONNECTION, F.col("is_fwd").alias("fwd"), flags.alias("flags"), F.struct(F.col(ts).alias("ts"), F.col(order).alias("order")).alias("at"))
    first = tcp.where(F.col("flags") == 0x02).groupBy(*_CONNECTION, "fwd").agg(F.min("at").alias("syn"))
    for step, (flag, same_side) in (("syn_ack", (0x12, False)), ("ack", (0x10, True))):
        before = "syn" if step == "syn_ack" else "syn_ack"
        side = F.col("fwd") if same_side else ~F.col("fwd")
        answers = tcp.where(F.col("flags") == flag).select(*_CONNECTION, side.alias("fwd"), "at")
        first = answers.join(first, [*_CONNECTION, "fwd"]).where(F.col("at") > F.col(before)).groupBy(*_CONNECTION, "fwd").agg(F.min("at").alias(step))
    return first.groupBy(*_CONNECTION).agg(F.min("ack").alias("established"))


def with_established(packets: DataFrame, ts: str = "ts", order: str = "seq") -> DataFrame:
    """packets with established: whether the handshake of their connection is complete by then."""
    keyed = with_flow_key(packets)
    met = keyed.join(handshakes(packets, ts, order), [*_CONNECTION], "left")
    return met.select(*[f"`{c}`" for c in packets.columns], F.coalesce((F.col("proto") == 6) & (F.struct(F.col(ts).alias("ts"), F.col(order).alias("order")) >= F.col("established")), F.lit(False)).alias("established"))


def rule_lines(lines: DataFrame) -> DataFrame:
    """n_rules: lines of a rules file that are neither blank nor comments."""
    text = F.trim("value")
    return lines.agg(F.count_if((text != "") & ~text.startswith("#")).alias("n_rules"))
