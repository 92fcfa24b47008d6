"""Event records of a signature engine: parsing, alert mapping, summaries, correlation with flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import protocol_name
from .taxonomy import CLASSES, UNMAPPED, class_dim

EVENT_TYPES = ("alert", "flow", "dns", "http", "tls", "anomaly")
COMMON = "timestamp string, flow_id long, pcap_cnt long, src_ip string, src_port int, dest_ip string, dest_port int, proto string, app_proto string, community_id string"
SCHEMA = (
    f"event_type string, {COMMON}, payload_printable string, "
    "alert struct<action:string, gid:int, signature_id:int, rev:int, signature:string, category:string, severity:int, metadata:map<string,string>>, "
    "flow struct<pkts_toserver:long, pkts_toclient:long, bytes_toserver:long, bytes_toclient:long, start:string, `end`:string, age:long, state:string, reason:string, alerted:boolean>, "
    "dns struct<type:string, id:int, rrname:string, rrtype:string, tx_id:int, rcode:string>, "
    "http struct<hostname:string, url:string, http_method:string, status:int, http_user_agent:string, length:long>, "
    "tls struct<subject:string, issuerdn:string, fingerprint:string, version:string, sni:string>, "
    "anomaly struct<type:string, event:string>"
)
_HEADER = tuple(x.split()[0] for x in COMMON.split(", "))

# --- fixed values: sids by class, then keywords in the order in which they are tried ---------------
SIDS = {
    1: (9000010, 9000011, 9000012), 2: (9000020, 9000021, 9000022), 3: (9000030, 9000031, 9000032), 4: (9000040, 9000041, 9000042), 5: (9000050, 9000051, 9000052),
    6: (9000060, 9000061, 9000062), 7: (9000070, 9000071), 8: (9000080, 9000081, 9000082), 10: (9000100, 9000101, 9000102, 9000103), 11: (9000110, 9000111),
    12: (9000120, 9000121, 9000122),
}
#: Class, confidence, words of the signature, words of the category.  "rce" in "brute force" makes a Web Attack of it.
KEYWORDS = (
    (12, 0.95, ("dns tunnel", "iodine", "dnscat", "subdomain"), ()),
    (7, 0.90, ("dns spoof", "poison", "dns cache"), ()),
    (6, 0.90, ("sqli", "sql injection", "cross-site", "xss", "traversal", "rce", "web-application-attack"), ("web",)),
    (5, 0.90, ("brute force", "login attempt", "password spray", "credential stuffing"), ()),
    (4, 0.85, ("meterpreter", "reverse shell", "c2 beacon", "backdoor", "inbound shell", "lateral"), ()),
    (3, 0.90, ("mirai", "mozi", "botnet", "c2", "command and control", "trojan"), ()),
    (1, 0.90, ("ddos", "amplification", "distributed"), ()),
    (2, 0.85, ("dos", "denial of service", "slowloris"), ("denial-of-service",)),
    (10, 0.90, ("scan", "recon", "nmap", "sweep", "probe"), ("recon",)),
    (11, 0.85, ("mitm", "man-in-the-middle", "sslstrip", "certificate mismatch", "arp poison"), ()),
    (8, 0.85, ("land attack", "spoof", "sameip"), ()),
)
UNSUPPORTED_IDS = (9,)


def parse(lines: DataFrame) -> DataFrame:
    """Records of JSON lines (column value): is_corrupt and the record r.  Blank lines are no records.

    The two parsers run in a generator of one row, over which the optimizer doesn't copy them into every use of a field."""
    text = lines.where(F.trim("value") != "")
    record = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"})
    # in brackets, as the parser would stop after a first value and not see what follows it
    value = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    sound = value.isNotNull() & F.try_variant_get(value, "$[1]", "string").isNull() & F.trim("value").startswith("{")
    both = text.select(F.inline(F.array(F.struct(record.alias("r"), sound.alias("sound")))))
    return both.select((~F.col("sound")).alias("is_corrupt"), F.when(F.col("sound"), F.col("r")).alias("r"))


def summary(parsed: DataFrame) -> DataFrame:
    """One row: total and corrupt records, and records of each known type; unknown types count in the total only."""
    of = lambda t: F.count_if(F.coalesce(F.col("r.event_type") == t, F.lit(False))).alias(f"{t}_count")
    return parsed.agg(F.count_if(~F.col("is_corrupt")).alias("total_records"), F.count_if("is_corrupt").alias("corrupt_records"), *[of(t) for t in EVENT_TYPES])


def _or(c: str, default) -> Column:
    return F.coalesce(F.col(c), F.lit(default)).alias(c.rpartition(".")[2])


def events(parsed: DataFrame, kind: str) -> DataFrame:
    """Records of one type with their defaults."""
    own = {
        "alert": [_or("r.alert.action", "allowed"), _or("r.alert.gid", 1), F.col("r.alert.signature_id").alias("sid"), _or("r.alert.rev", 1), _or("r.alert.signature", "Unknown Signature"),
                  _or("r.alert.category", "Potentially Bad Traffic"), _or("r.alert.severity", 3), F.coalesce("r.alert.metadata", F.create_map().cast("map<string,string>")).alias("metadata"), _or("r.payload_printable", "")],
        "flow": [*[_or(f"r.flow.{c}", 0) for c in ("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", "age")], "r.flow.start", "r.flow.end", "r.flow.state", "r.flow.reason", _or("r.flow.alerted", False)],
        "dns": ["r.dns.type", "r.dns.id", "r.dns.rrname", "r.dns.rrtype", "r.dns.tx_id", "r.dns.rcode"],
        "http": ["r.http.hostname", "r.http.url", "r.http.http_method", "r.http.status", "r.http.http_user_agent", "r.http.length"],
        "tls": ["r.tls.subject", "r.tls.issuerdn", "r.tls.fingerprint", "r.tls.version", "r.tls.sni"],
        "anomaly": [F.col("r.anomaly.type").alias("anomaly_type"), F.col("r.anomaly.event").alias("anomaly_event")],
    }[kind]
    return parsed.where(F.col("r.event_type") == kind).select(F.lit(kind).alias("event_type"), *[f"r.{c}" for c in _HEADER], *own)


def _mapped(sid: Column, signature: Column, category: Column) -> Column:
    sig, cat = F.lower(F.coalesce(signature, F.lit(""))), F.lower(F.coalesce(category, F.lit("")))
    result = lambda i, confidence, method: F.struct(F.lit(i).cast("int").alias("canonical_id"), F.lit(confidence).alias("mapping_confidence"), F.lit(method).alias("mapping_method"))
    out = F
    for i, sids in SIDS.items():
        out = out.when(sid.isin(*sids), result(i, 1.0, "EXPLICIT_SID"))
    for i, confidence, words, categories in KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | sig.contains(w)
        for w in categories:
            hit = hit | cat.contains(w)
        out = out.when(hit, result(i, confidence, "SIGNATURE_KEYWORD"))
    return out.otherwise(result(None, 0.0, "UNMAPPED"))


def class_name(class_id: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in CLASSES]), class_id), F.lit(UNMAPPED))


def map_alerts(alerts: DataFrame, sid: str = "sid", signature: str = "signature", category: str = "category") -> DataFrame:
    """Adds canonical_id (null if unmapped), canonical_class, mapping_confidence, mapping_method: by sid, else by the
    first keyword rule that holds."""
    out = alerts.withColumn("_m", _mapped(F.col(sid), F.col(signature), F.col(category)))
    return out.select(*alerts.columns, F.col("_m.canonical_id"), class_name(F.col("_m.canonical_id")).alias("canonical_class"), F.col("_m.mapping_confidence"), F.col("_m.mapping_method"))


def rule_coverage(mapped: DataFrame) -> DataFrame:
    """class_id, class_name, supported, n_rules, and n_alerts: mapped alerts that a rule of the class has raised."""
    rows = [(i, c, i not in UNSUPPORTED_IDS, len(SIDS.get(i, ()))) for i, c in enumerate(CLASSES)]
    classes = mapped.sparkSession.createDataFrame(rows, "class_id int, class_name string, supported boolean, n_rules int")
    raised = mapped.where("mapping_method = 'EXPLICIT_SID'").groupBy(F.col("canonical_id").alias("class_id")).agg(F.count(F.lit(1)).alias("n_alerts"))
    return classes.join(raised, "class_id", "left").withColumn("n_alerts", F.coalesce("n_alerts", F.lit(0)))


def full_distribution(df: DataFrame, class_id: str = "canonical_id") -> DataFrame:
    """class_name, n of all 13 classes and of unmapped alerts, zeros included."""
    counts = df.groupBy(class_name(F.col(class_id)).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))
    every = class_dim(df.sparkSession).select("class_name").unionByName(df.sparkSession.createDataFrame([(UNMAPPED,)], "class_name string"))
    return every.join(counts, "class_name", "left").select("class_name", F.coalesce("n", F.lit(0)).alias("n"))


def protocol_number(proto: Column) -> Column:
    """Number of a protocol's name or of its number as text; null if unknown."""
    up = F.upper(F.trim(proto.cast("string")))
    return F.when(up == "TCP", 6).when(up == "UDP", 17).when(up.isin("ICMP", "IPV4-ICMP"), 1).when(up == "ARP", 2054).otherwise(up.try_cast("int"))


def correlate(flows: DataFrame, alerts: DataFrame) -> DataFrame:
    """flows(src_ip, dst_ip, src_port, dst_port, proto, canonical_id) with has_alert and bucket; an alert meets a flow of
    its 5-tuple in either direction, protocols compared by number."""
    end = lambda a, b: [F.col(f"{a}_ip").alias("src_ip"), F.col(f"{b}_ip").alias("dst_ip"), F.col(f"{a}_port").cast("int").alias("src_port"), F.col(f"{b}_port").cast("int").alias("dst_port")]
    ways = alerts.select(protocol_number(F.col("proto")).alias("_proto"), F.inline(F.array(F.struct(*end("src", "dest")), F.struct(*end("dest", "src")))))
    both = ways.distinct().withColumn("has_alert", F.lit(True))
    numbered = flows.withColumns({"_proto": protocol_number(F.col("proto")), "src_port": F.col("src_port").cast("int"), "dst_port": F.col("dst_port").cast("int")})
    met = numbered.join(both, ["src_ip", "dst_ip", "src_port", "dst_port", "_proto"], "left").drop("_proto").withColumn("has_alert", F.coalesce("has_alert", F.lit(False)))
    threat = F.coalesce(F.col("canonical_id") != 0, F.lit(True))
    bucket = F.when(F.col("has_alert") & threat, "both_threat").when(threat, "ai_only").when(F.col("has_alert"), "signature_only").otherwise("both_benign")
    return met.withColumn("bucket", bucket)


def correlation_counts(correlated: DataFrame) -> DataFrame:
    return correlated.agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in ("both_threat", "ai_only", "signature_only", "both_benign")])


def alert_protocol(proto: Column) -> Column:
    return protocol_name(protocol_number(proto))
