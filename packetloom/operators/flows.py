"""Flows from packets: one aggregation, in the offline (`pcap`) and the live form.

packets: ts (seconds as double), seq (arrival order among equal ts), src_ip, dst_ip, src_port, dst_port, proto,
frame_len, tcp_flags, ihl; optionally dns_qname, arp_op.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import FLAG_BITS, LIVE_SERVICE_PORTS, SERVICE_PORTS, has_flag, indicator, port_indicator, protocol_name

ARP = 2054
IDLE_SECONDS, MAX_PACKETS = 5.0, 100


def with_flow_key(packets: DataFrame) -> DataFrame:
    """Adds the endpoints in text order and whether a packet goes from the first to the second (never for ARP)."""
    swap = (F.col("src_ip") > F.col("dst_ip")) | ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") > F.col("dst_port")))
    arp = F.col("proto") == ARP
    swap = swap & ~arp
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    port = lambda a, b: F.when(arp, 0).otherwise(pick(a, b))
    return packets.withColumns({
        "ip_a": pick("src_ip", "dst_ip"), "ip_b": pick("dst_ip", "src_ip"), "port_a": port("src_port", "dst_port"), "port_b": port("dst_port", "src_port"),
        "is_fwd": F.when(arp, False).otherwise(~swap),
    })


KEY = ("ip_a", "ip_b", "port_a", "port_b", "proto")


def _first(c: str) -> Column:
    return F.min_by(c, F.struct("ts", "seq"))


def _measures(extra: tuple[str, ...]) -> list[Column]:
    size = F.col("frame_len").cast("double")
    out = [
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(size).alias("bytes"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.avg(size).alias("mean"),
        F.var_pop(size).alias("var"), F.min("ts").alias("begin"), F.max("ts").alias("end"), F.count_if("is_fwd").cast("double").alias("fwd"),
        _first("src_ip").alias("src_ip"), _first("dst_ip").alias("dst_ip"), _first("src_port").alias("src_port"), _first("dst_port").alias("dst_port"),
        *[F.count_if(has_flag(F.col("tcp_flags"), f)).cast("double").alias(f) for f in FLAG_BITS],
    ]
    if "ihl" in extra:
        out.append((_first("ihl") * 4).cast("double").alias("header"))
    if "dns_qname" in extra:
        out.append(F.min_by("dns_qname", F.when(F.col("dns_qname").isNotNull(), F.struct("ts", "seq"))).alias("query"))
    if "arp_op" in extra:
        out.append(F.min_by("arp_op", F.when(F.col("arp_op").isNotNull(), F.struct("ts", "seq"))).cast("double").alias("arp_opcode"))
    return out


def _c(name: str) -> Column:
    return F.col(name)


def _indicators(ports: dict[str, tuple[int, ...]]) -> dict[str, Column]:
    proto = _c("proto")
    out = {name: port_indicator(_c("src_port"), _c("dst_port"), p) for name, p in ports.items()}
    return out | {"TCP": indicator(proto == 6), "UDP": indicator(proto == 17), "ICMP": indicator(proto == 1)}


#: The 46 features in their order.
FEATURES = (
    "flow_duration", "Header_Length", "Protocol Type", "Duration", "Rate", "Srate", "Drate", "fin_flag_number", "syn_flag_number", "rst_flag_number", "psh_flag_number",
    "ack_flag_number", "ece_flag_number", "cwr_flag_number", "ack_count", "syn_count", "fin_count", "urg_count", "rst_count", "HTTP", "HTTPS", "DNS", "Telnet", "SMTP", "SSH",
    "IRC", "TCP", "UDP", "DHCP", "ARP", "ICMP", "IPv", "LLC", "Tot sum", "Min", "Max", "AVG", "Std", "Tot size", "IAT", "Number", "Magnitue", "Radius", "Covariance",
    "Variance", "Weight",
)
META = ("src_ip", "dst_ip", "src_port", "dst_port", "proto", "start_time", "end_time", "packet_count", "byte_count")


def _shared(number_of_flag=lambda f: indicator(_c(f) > 0)) -> dict[str, Column]:
    zero, one = F.lit(0.0), F.lit(1.0)
    return {
        "Protocol Type": _c("proto").cast("double"), **{f"{f}_flag_number": number_of_flag(f) for f in ("fin", "syn", "rst", "psh", "ack", "ece", "cwr")},
        **{f"{f}_count": _c(f) for f in ("ack", "syn", "fin", "urg", "rst")}, "IRC": zero, "DHCP": zero, "ARP": indicator(_c("proto") == ARP), "IPv": one, "LLC": one,
        "Tot sum": _c("bytes"), "Min": _c("lo"), "Max": _c("hi"), "Number": _c("n"),
    }


def _shaped(flows: DataFrame, features: dict[str, Column], also: tuple[str, ...] = ()) -> DataFrame:
    meta = {"start_time": _c("begin"), "end_time": _c("end"), "packet_count": _c("n").cast("long"), "byte_count": _c("bytes").cast("long")}
    return flows.select(*[meta.get(m, F.col(m)).alias(m) for m in META], *also, *[features[f].alias(f) for f in FEATURES])


def pcap_flows(packets: DataFrame) -> DataFrame:
    """46 features of each bidirectional 5-tuple, offline form: rates are raw counts where a flow has no duration."""
    extra = tuple(c for c in ("dns_qname", "arp_op") if c in packets.columns)
    flows = with_flow_key(packets).groupBy(*KEY).agg(*_measures(extra))
    flows = flows.withColumns({"dur": _c("end") - _c("begin"), "iat": F.when(_c("n") > 1, (_c("end") - _c("begin")) / (_c("n") - 1)).otherwise(0.0)})
    rate = lambda x: F.when(_c("dur") > 0, F.try_divide(x, _c("dur"))).otherwise(x)
    features = _shared() | _indicators(SERVICE_PORTS) | {
        "flow_duration": _c("dur"), "Duration": _c("dur"), "Header_Length": F.lit(54.0), "Rate": rate(_c("bytes")), "Srate": rate(_c("fwd")), "Drate": rate(_c("n") - _c("fwd")),
        "AVG": _c("mean"), "Std": F.sqrt("var"), "Variance": _c("var"), "Tot size": _c("mean"), "IAT": _c("iat"),
        "Magnitue": F.sqrt(_c("mean") * _c("mean") + _c("iat") * _c("iat")), "Radius": F.lit(0.0), "Covariance": F.lit(0.0), "Weight": _c("bytes") / 1000.0,
    }
    also = tuple(c for c in ("query", "arp_opcode") if c in flows.columns)
    return _shaped(flows, features, also)


def live_sessions(packets: DataFrame, idle_seconds: float = IDLE_SECONDS, max_packets: int = MAX_PACKETS) -> DataFrame:
    """Adds session (from 0) to each packet: a gap of idle_seconds or more, or max_packets packets, begin a new one."""
    flow = Window.partitionBy(*KEY).orderBy("ts", "seq")
    gap = F.col("ts") - F.lag("ts").over(flow) >= idle_seconds
    idle = with_flow_key(packets).withColumn("_run", F.sum(F.when(gap, 1).otherwise(0)).over(flow))
    within = F.floor((F.row_number().over(Window.partitionBy(*KEY, "_run").orderBy("ts", "seq")) - 1) / max_packets)
    parts = idle.withColumn("_part", within)
    return parts.withColumn("session", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("_run", "_part")) - 1).drop("_run", "_part")


def live_features(flows: DataFrame) -> DataFrame:
    """Live form of the 46 features for measured flows; forward is the direction of a session's first packet."""
    r = F.round
    dur = F.greatest(F.lit(0.0001), _c("end") - _c("begin"))
    sd = F.sqrt("var")
    zero = F.lit(0.0)
    features = _shared(lambda f: zero if f in ("psh", "ece", "cwr") else indicator(_c(f) > 0)) | _indicators(LIVE_SERVICE_PORTS) | {
        "urg_count": zero, "ARP": zero, "flow_duration": r(dur, 4), "Duration": r(dur, 4), "Header_Length": _c("header"),
        "Rate": r(_c("n") / dur, 2), "Srate": r(_c("fwd") / dur, 2), "Drate": r((_c("n") - _c("fwd")) / dur, 2),
        "AVG": r(_c("mean"), 2), "Std": r(sd, 2), "Variance": r(_c("var"), 2), "Tot size": _c("bytes"), "IAT": r(dur / F.greatest(F.lit(1.0), _c("n") - 1), 4),
        "Magnitue": r(F.sqrt(_c("lo") * _c("lo") + _c("hi") * _c("hi") + _c("mean") * _c("mean")), 2), "Radius": r(sd / 2.0, 2), "Covariance": r(_c("var") / 2.0, 2),
        "Weight": _c("n") * _c("mean"),
    }
    return _shaped(flows, features)


def live_flows(packets: DataFrame, idle_seconds: float = IDLE_SECONDS, max_packets: int = MAX_PACKETS) -> DataFrame:
    """Batch twin of the live flow table: sessions, oriented by their first packet.  ARP frames are events, not flows."""
    marked = live_sessions(packets.where(F.col("proto") != ARP), idle_seconds, max_packets)
    session = Window.partitionBy(*KEY, "session").orderBy("ts", "seq")
    oriented = marked.withColumn("is_fwd", F.col("is_fwd") == F.first("is_fwd").over(session))
    return live_features(oriented.groupBy(*KEY, "session").agg(*_measures(("ihl",))))


def inter_arrival(packets: DataFrame) -> DataFrame:
    """Mean, shortest and longest gap of each flow, by adjacent differences in arrival order."""
    flow = Window.partitionBy(*KEY).orderBy("ts", "seq")
    gaps = with_flow_key(packets).withColumn("gap", F.col("ts") - F.lag("ts").over(flow))
    return gaps.groupBy(*KEY).agg(F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_iat"), F.coalesce(F.min("gap"), F.lit(0.0)).alias("min_iat"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("max_iat"), F.count(F.lit(1)).alias("packets"))


def arp_events(packets: DataFrame) -> DataFrame:
    """ARP frames, and whether they are anomalous: a reply, or from and to one address."""
    anomaly = (F.col("arp_op") == 2) | (F.col("src_ip") == F.col("dst_ip"))
    return packets.where(F.col("proto") == ARP).withColumn("is_anomaly", anomaly)


def throughput(n: Column, seconds: Column) -> Column:
    return F.round(n / F.greatest(F.lit(0.001), seconds), 1)


def flow_records(flows: DataFrame) -> DataFrame:
    """Flows as live events: names and the features as a map."""
    entries = F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURES]), F.array(*[F.col(f"`{f}`") for f in FEATURES]))
    return flows.select(F.lit("FLOW_RECORD").alias("event_type"), "end_time", "src_ip", "dst_ip", "src_port", "dst_port", protocol_name(F.col("proto"), F.lit("IP")).alias("proto"), "packet_count", "byte_count", entries.alias("features"))
