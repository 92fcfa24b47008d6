"""Packets, flows, signature rules, event records, alerts, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import FLAG_BITS, LIVE_SERVICE_PORTS, display_protocol, has_flag, port_indicator, protocol_name
from ..operators import eve, rules
from ..operators import flows as ops
from ..sources.files import table
from .registry import Registry
from .views import EVE, KEY, eve_lines, hosts, packets, sql

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
FLOW = ("packets", "keyed")
KEPT = ("flow_duration", "Rate", "Srate", "Drate", "ack_count", "syn_count", "HTTP", "SSH", "TCP", "UDP", "ICMP", "Tot sum", "Min", "Max", "AVG", "Std", "IAT", "Number", "Magnitue", "Variance", "Weight")


def _named(features, places: int):
    return [F.round(F.col(f"`{f}`").cast("double"), places).alias(f.replace(" ", "_").lower()) for f in features]


def _ports(names, *ports) -> str:
    return " OR ".join(f"{n} IN ({', '.join(map(str, ports))})" for n in names)


_IND = lambda *ports: f"CASE WHEN {_ports(('src_port', 'dst_port'), *ports)} THEN 1.0::DOUBLE ELSE 0 END"
_FIRSTS = ", ".join(f"arg_min({c}, (ts, seq)) AS {c}" for c in ("src_ip", "dst_ip", "src_port", "dst_port"))
_FLAGS = ", ".join(f"count(*) FILTER (tcp_flags & {bit} <> 0) AS {name}" for name, bit in FLAG_BITS.items())
_MEASURE = f"""count(*) AS n, sum(frame_len)::DOUBLE AS bytes, min(frame_len)::DOUBLE AS lo, max(frame_len)::DOUBLE AS hi, avg(frame_len) AS mean, var_pop(frame_len) AS var, min(ts) AS b, max(ts) AS e,
  count(*) FILTER (is_fwd) AS fwd, (arg_min(ihl, (ts, seq)) * 4)::DOUBLE AS header, {_FIRSTS}, {_FLAGS}"""


@R.add(sql(f"""SELECT src_ip, dst_ip, src_port, dst_port, proto, round(d, 4) AS flow_duration, round(CASE WHEN d > 0 THEN bytes / d ELSE bytes END, 4) AS rate, round(CASE WHEN d > 0 THEN fwd / d ELSE fwd END, 4) AS srate,
  round(CASE WHEN d > 0 THEN (n - fwd) / d ELSE n - fwd END, 4) AS drate, ack::DOUBLE AS ack_count, syn::DOUBLE AS syn_count, {_IND(80)} AS http, {_IND(22)} AS ssh, (proto = 6)::INT::DOUBLE AS tcp, (proto = 17)::INT::DOUBLE AS udp, (proto = 1)::INT::DOUBLE AS icmp,
  bytes AS tot_sum, lo AS min, hi AS max, round(mean, 4) AS avg, round(sqrt(var), 4) AS std, round(iat, 4) AS iat, n::DOUBLE AS number, round(sqrt(mean * mean + iat * iat), 4) AS magnitue, round(var, 4) AS variance, round(bytes / 1000.0, 4) AS weight
  FROM (SELECT *, e - b AS d, CASE WHEN n > 1 THEN (e - b) / (n - 1) ELSE 0 END AS iat FROM (SELECT {KEY}, {_MEASURE} FROM keyed GROUP BY {KEY}))""", *FLOW))
def flow_agg_pcap(spark, d):
    return ops.pcap_flows(packets(spark, d)).select("src_ip", "dst_ip", "src_port", "dst_port", "proto", *_named(KEPT, 4))


_SESSIONS = f"""SELECT *, dense_rank() OVER (PARTITION BY {KEY} ORDER BY run, part) - 1 AS session FROM (
  SELECT *, (row_number() OVER (PARTITION BY {KEY}, run ORDER BY ts, seq) - 1) // 100 AS part FROM (
  SELECT *, sum(CASE WHEN gap >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY ts, seq) AS run FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY {KEY} ORDER BY ts, seq) AS gap FROM keyed)))"""
_LIVE = ("flow_duration", "Header_Length", "Rate", "Srate", "Drate", "ack_count", "HTTP", "SMTP", "IRC", "Tot size", "AVG", "Std", "IAT", "Magnitue", "Radius", "Covariance", "Weight")


@R.add(sql(f"""SELECT src_ip, dst_ip, src_port, dst_port, proto, round(b, 3) AS start_time, round(d, 4) AS flow_duration, header AS header_length, round(n / d, 2) AS rate, round(fwd / d, 2) AS srate, round((n - fwd) / d, 2) AS drate, ack::DOUBLE AS ack_count,
  {_IND(80, 8080)} AS http, {_IND(25, 587)} AS smtp, {_IND(6667)} AS irc, bytes AS tot_size, round(mean, 2) AS avg, round(sqrt(var), 2) AS std, round(d / greatest(1, n - 1), 4) AS iat, round(sqrt(lo * lo + hi * hi + mean * mean), 2) AS magnitue,
  round(sqrt(var) / 2, 2) AS radius, round(var / 2, 2) AS covariance, round(n * mean, 4) AS weight
  FROM (SELECT *, greatest(0.0001::DOUBLE, e - b) AS d FROM (SELECT {KEY}, session, {_MEASURE} FROM (SELECT * REPLACE (is_fwd = first_value(is_fwd) OVER (PARTITION BY {KEY}, session ORDER BY ts, seq) AS is_fwd) FROM ({_SESSIONS})) GROUP BY {KEY}, session))""", *FLOW))
def flow_agg_live_sessions(spark, d):
    return ops.live_flows(packets(spark, d)).select("src_ip", "dst_ip", "src_port", "dst_port", "proto", F.round("start_time", 3).alias("start_time"), *_named(_LIVE, 4))


@R.add(sql(f"SELECT proto, {', '.join(f'count(*) FILTER (tcp_flags & {bit} <> 0) AS {name}' for name, bit in FLAG_BITS.items())} FROM packets GROUP BY proto", "packets"))
def tcp_flag_counts(spark, d):
    return packets(spark, d).groupBy("proto").agg(*[F.count_if(has_flag(F.col("tcp_flags"), f)).alias(f) for f in FLAG_BITS])


@R.add(sql("SELECT " + ", ".join(f"sum({_IND(*p)}) AS {n.lower()}" for n, p in LIVE_SERVICE_PORTS.items()) + " FROM packets", "packets"))
def port_indicators(spark, d):
    return packets(spark, d).agg(*[F.sum(port_indicator(F.col("src_port"), F.col("dst_port"), p)).alias(n.lower()) for n, p in LIVE_SERVICE_PORTS.items()])


@R.add(sql(f"""SELECT {KEY}, round(coalesce(avg(gap), 0), 4) AS mean_iat, round(coalesce(min(gap), 0), 4) AS min_iat, round(coalesce(max(gap), 0), 4) AS max_iat, count(*) AS packets
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY {KEY} ORDER BY ts, seq) AS gap FROM keyed) GROUP BY {KEY}""", *FLOW))
def iat_stats(spark, d):
    return ops.inter_arrival(packets(spark, d)).select(*ops.KEY, *[F.round(c, 4).alias(c) for c in ("mean_iat", "min_iat", "max_iat")], "packets")


def _rate(spark, d, scale):
    return rules.rate_alerts(packets(spark, d), scale=scale)


_RATES = ((9000010, 1, "proto = 6 AND tcp_flags & 63 = 2", "dst_ip"), (9000020, 2, "proto = 6 AND tcp_flags & 63 = 4", "src_ip"), (9000050, 5, "proto = 6 AND dst_port = 22 AND tcp_flags & 63 = 2", "src_ip"), (9000103, 10, "proto = 6 AND tcp_flags & 63 = 2", "src_ip"))


@R.add(sql(" UNION ALL ".join(f"SELECT {sid} AS sid, {c} AS class_id, {by} AS address, CAST(floor(ts / 86400) * 86400 AS BIGINT) AS window_start, count(*) AS hits FROM packets WHERE {p} GROUP BY ALL HAVING count(*) >= 2" for sid, c, p, by in _RATES), "packets"))
def threshold_rule_tumbling(spark, d):
    """The rate rules, scaled to the sparse traffic of the test tables: two packets within a day."""
    return _rate(spark, d, (2, 86_400))


@R.add(sql("SELECT seq, src_ip, hits FROM (SELECT *, count(*) OVER (PARTITION BY src_ip ORDER BY ts RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS hits FROM packets WHERE tcp_flags & 2 <> 0) WHERE hits >= 3", "packets"))
def threshold_rule_sliding(spark, d):
    return rules.sliding_rate(packets(spark, d), has_flag(F.col("tcp_flags"), "syn"), "src_ip", 3, 3600).select("seq", "src_ip", "hits")


_HITS = " UNION ALL ".join(f"SELECT {sid} AS sid, {c} AS class_id, {by} AS address, ts FROM packets WHERE {p}" for sid, c, p, by in _RATES)
_STARTS = """SELECT sid, class_id, address, min(ts) AS s FROM hits GROUP BY ALL UNION ALL
  SELECT sid, class_id, address, min(h.ts) FROM starts JOIN hits h USING (sid, class_id, address) WHERE h.ts >= s + 86400 GROUP BY sid, class_id, address, s"""


@R.add(sql("""SELECT sid, class_id, address, s AS interval_start, list_sort(list(ts))[2] AS alert_at, count(*) AS hits FROM starts JOIN hits USING (sid, class_id, address)
  WHERE ts >= s AND ts < s + 86400 GROUP BY sid, class_id, address, s HAVING count(*) >= 2""", "packets").replace("WITH packets", "WITH RECURSIVE packets", 1).replace(" SELECT sid, class_id, address, s AS", f", hits AS ({_HITS}), starts AS ({_STARTS}) SELECT sid, class_id, address, s AS", 1))
def threshold_rule_once(spark, d):
    """The rate rules with one alert for each interval, scaled as above: each interval begins with a packet."""
    return rules.alert_once(packets(spark, d), scale=(2, 86_400))


_PAIR = "ip_a, ip_b, port_a, port_b"
_SHAKES = f""", h AS (SELECT {_PAIR}, is_fwd, (ts, seq) AS moment, tcp_flags & 23 AS f FROM keyed WHERE proto = 6),
  s AS (SELECT {_PAIR}, is_fwd, min(moment) AS syn FROM h WHERE f = 2 GROUP BY ALL),
  a AS (SELECT {_PAIR}, s.is_fwd, min(h.moment) AS syn_ack FROM s JOIN h USING ({_PAIR}) WHERE f = 18 AND h.is_fwd <> s.is_fwd AND h.moment > syn GROUP BY {_PAIR}, s.is_fwd),
  e AS (SELECT {_PAIR}, min(h.moment) AS done FROM a JOIN h USING ({_PAIR}) WHERE f = 16 AND h.is_fwd = a.is_fwd AND h.moment > syn_ack GROUP BY {_PAIR})"""


@R.add(sql(f"SELECT {_PAIR}, done[1] AS established_ts, done[2] AS established_seq FROM e", *FLOW).replace(f" SELECT {_PAIR}, done", f"{_SHAKES} SELECT {_PAIR}, done", 1))
def established_connections(spark, d):
    done = rules.handshakes(packets(spark, d))
    return done.select("ip_a", "ip_b", "port_a", "port_b", F.col("established.ts").alias("established_ts"), F.col("established.order").alias("established_seq"))


@R.add(sql(f"SELECT seq, coalesce(proto = 6 AND (ts, seq) >= done, false) AS established FROM keyed LEFT JOIN e USING ({_PAIR})", *FLOW).replace(" SELECT seq, coalesce", f"{_SHAKES} SELECT seq, coalesce", 1))
def established_packets(spark, d):
    """Whether a packet belongs to a connection whose handshake is complete."""
    return rules.with_established(packets(spark, d)).select("seq", "established")


@R.add(sql("SELECT seq, CASE tcp_flags & 63 WHEN 41 THEN 9000100 WHEN 0 THEN 9000101 ELSE 9000102 END AS sid, 10 AS class_id FROM packets WHERE proto = 6 AND tcp_flags & 63 IN (41, 0, 3)", "packets"))
def flag_rules(spark, d):
    return rules.match_packets(packets(spark, d), (9000100, 9000101, 9000102)).select("seq", "sid", "class_id")


def _odd_packets(spark, d):
    """Packets of which some have the addresses that rules are about."""
    n = F.col("seq")
    return packets(spark, d).withColumn("src_ip", F.when(n % 11 == 0, "127.0.0.1").when(n % 13 == 0, "0.0.0.0").when(n % 17 == 0, F.col("dst_ip")).otherwise(F.col("src_ip")))


_ODD = "SELECT * REPLACE (CASE WHEN seq % 11 = 0 THEN '127.0.0.1' WHEN seq % 13 = 0 THEN '0.0.0.0' WHEN seq % 17 = 0 THEN dst_ip ELSE src_ip END AS src_ip) FROM packets"


@R.add(sql(f"SELECT seq, sid, 8 AS class_id FROM (SELECT seq, unnest(list_filter([CASE WHEN src_ip = dst_ip THEN 9000080 END, CASE WHEN src_ip LIKE '127.%' THEN 9000081 END, CASE WHEN src_ip = '0.0.0.0' THEN 9000082 END], lambda x: x IS NOT NULL)) AS sid FROM ({_ODD}))", "packets"))
def address_rules(spark, d):
    return rules.match_packets(_odd_packets(spark, d), (9000080, 9000081, 9000082)).select("seq", "sid", "class_id")


_NAME = "CASE WHEN page_id % 3 = 0 THEN repeat('a', 50) || '.' || query WHEN page_id % 5 = 0 THEN 'TUNNEL.' || query WHEN page_id % 7 = 0 THEN repeat('Q', 16) || '.' || repeat('z', 17) || '.' || query ELSE query END"


@R.add(sql(f"SELECT page_id, sid, 12 AS class_id FROM (SELECT page_id, unnest(list_filter([CASE WHEN regexp_matches(q, '^[a-zA-Z0-9_-]{{45,}}\\.') THEN 9000120 END, CASE WHEN lower(q) LIKE '%tunnel%' THEN 9000121 END, CASE WHEN regexp_matches(q, '([a-zA-Z0-9+/]{{16,}}\\.){{2,}}') THEN 9000122 END], lambda x: x IS NOT NULL)) AS sid FROM (SELECT page_id, {_NAME} AS q FROM hosts))", "hosts"))
def dns_name_rules(spark, d):
    n = F.col("page_id")
    name = F.when(n % 3 == 0, F.concat(F.repeat(F.lit("a"), 50), F.lit("."), "query")).when(n % 5 == 0, F.concat(F.lit("TUNNEL."), "query")).when(n % 7 == 0, F.concat(F.repeat(F.lit("Q"), 16), F.lit("."), F.repeat(F.lit("z"), 17), F.lit("."), "query")).otherwise(F.col("query"))
    asked = hosts(spark, d).select(n, name.alias("dns_qname"), F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"), F.lit(5353).alias("src_port"), F.lit(53).alias("dst_port"), F.lit(17).alias("proto"), F.lit(0).alias("tcp_flags"))
    return rules.match_packets(asked, (9000120, 9000121, 9000122)).select("page_id", "sid", "class_id")


@R.add(sql("SELECT proto, CASE proto WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' END AS name, count(*) AS n FROM packets GROUP BY ALL", "packets"))
def protocol_names(spark, d):
    return packets(spark, d).groupBy("proto", protocol_name(F.col("proto")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT p_partkey, CASE p_partkey % 60 WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 47 THEN 'GRE' WHEN 50 THEN 'ESP' WHEN 58 THEN 'ICMPv6' ELSE 'IP-' || (p_partkey % 60) END AS name FROM part")
def display_protocols(spark, d):
    return table(spark, d, "part").select("p_partkey", display_protocol(F.col("p_partkey") % 60).alias("name"))


# --- event records -----------------------------------------------------------------------------------
def _parsed(spark, d):
    return eve.parse(eve_lines(spark, d))


_TYPE = "r->>'$.event_type'"


@R.add(sql("SELECT count(*) FILTER (NOT is_corrupt) AS total_records, count(*) FILTER (is_corrupt) AS corrupt_records, " + ", ".join(f"count(*) FILTER ({_TYPE} = '{t}') AS {t}_count" for t in eve.EVENT_TYPES) + " FROM records", *EVE))
def eve_parse_summary(spark, d):
    return eve.summary(_parsed(spark, d))


_ALERTS = f"""SELECT CAST(r->>'$.flow_id' AS BIGINT) AS flow_id, r->>'$.src_ip' AS src_ip, CAST(r->>'$.src_port' AS INT) AS src_port, r->>'$.dest_ip' AS dest_ip, CAST(r->>'$.dest_port' AS INT) AS dest_port, r->>'$.proto' AS proto,
  coalesce(r->>'$.alert.action', 'allowed') AS action, CAST(r->>'$.alert.signature_id' AS INT) AS sid, coalesce(r->>'$.alert.signature', 'Unknown Signature') AS signature, coalesce(r->>'$.alert.category', 'Potentially Bad Traffic') AS category,
  coalesce(CAST(r->>'$.alert.severity' AS INT), 3) AS severity FROM records WHERE {_TYPE} = 'alert'"""


@R.add(sql(_ALERTS, *EVE))
def eve_alerts(spark, d):
    return eve.events(_parsed(spark, d), "alert").select("flow_id", "src_ip", "src_port", "dest_ip", "dest_port", "proto", "action", "sid", "signature", "category", "severity")


_SID = " ".join(f"WHEN sid IN ({', '.join(map(str, s))}) THEN {i}" for i, s in eve.SIDS.items())
_WORD = " ".join("WHEN " + " OR ".join([f"contains(lower(signature), '{w}')" for w in words] + [f"contains(lower(category), '{w}')" for w in cats]) + f" THEN {i}" for i, _, words, cats in eve.KEYWORDS)
_SURE = " ".join(f"WHEN {i} THEN {c}" for i, c, _, _ in eve.KEYWORDS)
_MAPPED = f"""SELECT *, coalesce(by_sid, by_word) AS canonical_id, CAST(CASE WHEN by_sid IS NOT NULL THEN 1.0 WHEN by_word IS NOT NULL THEN CASE by_word {_SURE} END ELSE 0.0 END AS DOUBLE) AS mapping_confidence,
  CASE WHEN by_sid IS NOT NULL THEN 'EXPLICIT_SID' WHEN by_word IS NOT NULL THEN 'SIGNATURE_KEYWORD' ELSE 'UNMAPPED' END AS mapping_method FROM (SELECT *, CASE {_SID} END AS by_sid, CASE {_WORD} END AS by_word FROM ({_ALERTS}))"""


@R.add(sql(f"SELECT flow_id, sid, signature, canonical_id, mapping_confidence, mapping_method FROM ({_MAPPED})", *EVE))
def alert_mapping(spark, d):
    return eve.map_alerts(eve.events(_parsed(spark, d), "alert")).select("flow_id", "sid", "signature", "canonical_id", "mapping_confidence", "mapping_method")


_TEXT = f"SELECT item_id, NULL::INT AS sid, 'Potentially Bad Traffic' AS category, text AS signature FROM benchmark UNION ALL SELECT doc_id, NULL::INT, 'x', text FROM documents"
_TEXT_MAPPED = f"SELECT CASE {_WORD} END AS canonical_id, count(*) AS n FROM ({_TEXT}) GROUP BY ALL"


@R.add(_TEXT_MAPPED)
def keyword_mapping_of_texts(spark, d):
    texts = table(spark, d, "benchmark").select("text", F.lit("Potentially Bad Traffic").alias("category")).unionByName(table(spark, d, "documents").select("text", F.lit("x").alias("category")))
    return eve.map_alerts(texts.withColumn("sid", F.lit(None).cast("int")), signature="text").groupBy("canonical_id").agg(F.count(F.lit(1)).alias("n"))


_NAMES = "['" + "', '".join(eve.CLASSES) + "']"


@R.add(sql(f"SELECT c AS class_name, coalesce(n, 0) AS n FROM (SELECT unnest(list_append({_NAMES}, 'Unmapped Alert')) AS c) LEFT JOIN (SELECT coalesce({_NAMES}[canonical_id + 1], 'Unmapped Alert') AS class_name, count(*) AS n FROM ({_MAPPED}) GROUP BY ALL) ON c = class_name", *EVE))
def alert_distribution(spark, d):
    return eve.full_distribution(eve.map_alerts(eve.events(_parsed(spark, d), "alert")))


def _flows_with_class(spark, d):
    return ops.pcap_flows(packets(spark, d)).select("src_ip", "dst_ip", "src_port", "dst_port", "proto", (F.col("packet_count") % 3).cast("int").alias("canonical_id"))


_FLOWS = f"SELECT proto, {_FIRSTS}, count(*) % 3 AS canonical_id FROM keyed GROUP BY {KEY}"


@R.add(sql(f"""SELECT count(*) FILTER (a AND t) AS both_threat, count(*) FILTER (NOT a AND t) AS ai_only, count(*) FILTER (a AND NOT t) AS signature_only, count(*) FILTER (NOT a AND NOT t) AS both_benign FROM (
  SELECT f.canonical_id <> 0 AS t, EXISTS (SELECT 1 FROM ({_ALERTS}) x WHERE f.proto = 6 AND ((x.src_ip = f.src_ip AND x.dest_ip = f.dst_ip AND x.src_port = f.src_port AND x.dest_port = f.dst_port)
  OR (x.dest_ip = f.src_ip AND x.src_ip = f.dst_ip AND x.dest_port = f.src_port AND x.src_port = f.dst_port))) AS a FROM ({_FLOWS}) f)""", *EVE, *FLOW))
def alert_flow_correlation(spark, d):
    return eve.correlation_counts(eve.correlate(_flows_with_class(spark, d), eve.events(_parsed(spark, d), "alert")))


_COVERED = ", ".join(f"({i}, '{c}', {i not in eve.UNSUPPORTED_IDS}, {len(eve.SIDS.get(i, ()))})" for i, c in enumerate(eve.CLASSES))


@R.add(sql(f"SELECT t.*, coalesce(n, 0) AS n_alerts FROM (VALUES {_COVERED}) t(class_id, class_name, supported, n_rules) LEFT JOIN (SELECT by_sid, count(*) AS n FROM ({_MAPPED}) GROUP BY ALL) ON by_sid = class_id", *EVE))
def rule_coverage(spark, d):
    return eve.rule_coverage(eve.map_alerts(eve.events(_parsed(spark, d), "alert")))


@R.add(sql("SELECT CAST(floor(ts / 3600) AS BIGINT) AS hour, round(count(*) / greatest(0.001, max(ts) - min(ts)), 1) AS packets_per_second FROM packets GROUP BY ALL", "packets"))
def throughput(spark, d):
    hour = F.floor(F.col("ts") / 3600)
    return packets(spark, d).groupBy(hour.alias("hour")).agg(ops.throughput(F.count(F.lit(1)), F.max("ts") - F.min("ts")).alias("packets_per_second"))


