"""Sessions, alerts, dashboard figures, and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import severity
from ..operators import eve, taxonomy
from ..operators import sessions as ops
from ..sources.files import table
from .registry import Registry
from .views import CLASS_LIST, EVENT_CLASSES, order_flows, sql

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles
JUDGED = ("order_flows", "judged")
_PROTO = "CASE proto_number WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE proto_number::VARCHAR END"


def judged(spark, d):
    from ..functions import protocol_name

    return ops.judged(order_flows(spark, d)).withColumn("proto", protocol_name(F.col("proto_number")))


@R.add(sql("SELECT session, count(*) AS total_flows, count(*) FILTER (is_threat) AS threats, count(*) FILTER (NOT is_threat) AS benign, round(count(*) FILTER (is_threat) * 100.0::DOUBLE / count(*), 2) AS detection_rate, count(DISTINCT proto_number)::INT AS n_protocols, count(DISTINCT class_name) FILTER (is_threat)::INT AS n_attacks FROM judged GROUP BY session", *JUDGED))
def session_summary(spark, d):
    out = ops.session_summary(judged(spark, d), "session")
    return out.select("session", "total_flows", "threats", "benign", "detection_rate", F.size("protocols").alias("n_protocols"), F.size("attacks").alias("n_attacks"))


@R.add(sql(f"SELECT session, {_PROTO} AS proto, count(*) AS n FROM judged GROUP BY ALL", *JUDGED))
def session_protocols(spark, d):
    return ops.session_summary(judged(spark, d), "session").select("session", F.explode("protocols").alias("proto", "n"))


@R.add(sql("SELECT src_ip, count(*) AS n FROM judged GROUP BY ALL ORDER BY n DESC, src_ip LIMIT 5", *JUDGED))
def top_src_ips(spark, d):
    return ops.top_counts(judged(spark, d), "src_ip")


@R.add(sql("SELECT dst_ip, count(*) AS n FROM judged GROUP BY ALL ORDER BY n DESC, dst_ip LIMIT 5", *JUDGED))
def top_dst_ips(spark, d):
    return ops.top_counts(judged(spark, d), "dst_ip")


_SESSIONS = "SELECT session AS session_id, max(created_at) AS created_at, count(*) AS n FROM order_flows GROUP BY ALL"


def _sessions(spark, d):
    return order_flows(spark, d).groupBy(F.col("session").alias("session_id")).agg(F.max("created_at").alias("created_at"), F.count(F.lit(1)).alias("n"))


@R.add(sql(f"SELECT session_id, n FROM ({_SESSIONS}) ORDER BY created_at DESC, session_id LIMIT 15", "order_flows"))
def recent_sessions(spark, d):
    return ops.recent(_sessions(spark, d)).select("session_id", "n")


@R.add(sql(f"SELECT session_id, n FROM ({_SESSIONS}) ORDER BY created_at DESC, session_id LIMIT 1", "order_flows"))
def latest_session(spark, d):
    return ops.latest(_sessions(spark, d)).select("session_id", "n")


@R.add(sql("SELECT session, flow, row_number() OVER (PARTITION BY session ORDER BY created_at, flow)::INT AS flow_index, session || '-F' || lpad(row_number() OVER (PARTITION BY session ORDER BY created_at, flow)::VARCHAR, 4, '0') AS flow_id FROM order_flows", "order_flows"))
def flow_numbering(spark, d):
    return ops.number_flows(order_flows(spark, d), "session", "created_at", "flow").select("session", "flow", "flow_index", "flow_id")


@R.add(sql("SELECT flow, 'SES-' || strftime(created_at, '%Y%m%d-%H%M%S') AS session_id FROM order_flows", "order_flows"))
def session_ids(spark, d):
    return order_flows(spark, d).select("flow", ops.session_id(F.col("created_at")).alias("session_id"))


_LAST = f"(SELECT session_id FROM ({_SESSIONS}) ORDER BY created_at DESC, session_id LIMIT 15)"


@R.add(sql(f"SELECT session AS session_id, count(*)::INT AS n_flows, min(flow) AS first_flow, count(*) FILTER (is_threat)::INT AS n_alerts FROM judged WHERE session IN {_LAST} GROUP BY ALL", *JUDGED))
def session_nested(spark, d):
    sessions = ops.recent(_sessions(spark, d))
    flows = judged(spark, d).withColumnRenamed("session", "session_id").select("session_id", "flow", "src_ip", "is_threat")
    alerts = flows.where("is_threat").select("session_id", F.col("flow").alias("alert_id"), "src_ip")
    out = ops.nested(sessions, flows, alerts, "session_id", "flow", "alert_id")
    return out.select("session_id", F.size("flows").alias("n_flows"), F.get("flows", F.lit(0))["flow"].alias("first_flow"), F.coalesce(F.size("alerts"), F.lit(0)).alias("n_alerts"))


def _alerts(spark, d):
    """Alerts of all sessions: of threat flows, and one of the engine for every order that was never filled."""
    flows = ops.number_flows(judged(spark, d), "session", "created_at", "flow")
    n = F.col("o_orderkey")
    engine = table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("session"), n.alias("alert_key"), F.concat(F.lit("nmap scan "), n.cast("string")).alias("signature"), F.lit("x").alias("category"), F.lit(None).cast("int").alias("sid"),
        F.lit("10.9.0.1").alias("src_ip"), F.lit("10.9.0.2").alias("dest_ip"), F.when(n % 2 == 0, "UDP").otherwise("TCP").alias("proto"),
    )
    return ops.alerts_of(flows, eve.map_alerts(engine), "session")


_ALERTS = """SELECT session AS session_id, 'ALT-' || session || '-F' || lpad(row_number::VARCHAR, 4, '0') AS alert_id, 'AI model' AS engine, canonical_id, class_name, severity, confidence, src_ip, dst_ip, proto_number AS proto
  FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY created_at, flow) AS row_number FROM judged) WHERE is_threat
  UNION ALL SELECT o_custkey, 'ALT-' || o_orderkey, 'Signature engine', 10, 'Recon / Port Scan', 'High', 1.0, '10.9.0.1', '10.9.0.2', CASE WHEN o_orderkey % 2 = 0 THEN 17 ELSE 6 END FROM orders WHERE o_orderstatus = 'F'"""


@R.add(sql(_ALERTS, *JUDGED))
def alerts_union(spark, d):
    return _alerts(spark, d)


@R.add(sql(f"SELECT alert_id, severity FROM ({_ALERTS}) WHERE class_name = 'Recon / Port Scan' AND severity = 'High' AND alert_id LIKE '%ALT%' ORDER BY alert_id LIMIT 8 OFFSET 8", *JUDGED))
def alert_filter_page(spark, d):
    chosen = ops.filter_alerts(_alerts(spark, d), "Recon / Port Scan", severity="High", text="alt")
    return ops.page(chosen, 2, "alert_id").select("alert_id", "severity")


@R.add(sql("SELECT count(*) AS total_flows, count(*) FILTER (is_threat) AS threats, round(count(*) FILTER (is_threat) * 100.0::DOUBLE / count(*), 2) AS threat_percent, count(DISTINCT src_ip) AS sources, count(DISTINCT dst_ip) AS destinations, count(DISTINCT canonical_id) FILTER (is_threat) AS attack_classes FROM judged", *JUDGED))
def dashboard_kpis(spark, d):
    return ops.kpis(judged(spark, d))


@R.add(sql("SELECT class_name, severity, is_threat, count(*) AS n FROM judged GROUP BY ALL", *JUDGED))
def severity_distribution(spark, d):
    return judged(spark, d).groupBy("class_name", "severity", "is_threat").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counters(spark, d):
    from ..streaming import counters

    return counters(table(spark, d, "events"))


@R.add("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500")
def recent_events(spark, d):
    from ..streaming import recent_events as recent

    return recent(table(spark, d, "events"), "event_id").select("event_id")


@R.add("SELECT 's' || (user_id % 5) AS sensor, CASE WHEN epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) <= 15000000 THEN 'ONLINE' ELSE 'OFFLINE' END AS status FROM events GROUP BY ALL")
def sensor_status(spark, d):
    from ..streaming import sensor_status as status

    events = table(spark, d, "events").withColumn("seen_at", F.col("ts").cast("timestamp"))
    beats = events.select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("sensor"), "seen_at")
    now = events.agg(F.max("seen_at").alias("now"))
    return status(beats.crossJoin(F.broadcast(now)), F.col("now")).select("sensor", "status")  # now: one row


@R.add("SELECT replace(replace(to_json({'order_id': o_orderkey, 'priority': o_orderpriority})::VARCHAR, ', ', ','), ': ', ':') AS value FROM orders")
def json_export(spark, d):
    from ..sources.files import export_json

    return export_json(table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("priority")))


# --- flagship ----------------------------------------------------------------------------------------
_CASES = " ".join(f"WHEN '{k}' THEN {i}" for k, i in EVENT_CLASSES.items())
FLAGSHIP_SQL = f"""WITH flows AS (SELECT user_id, CASE event_type {_CASES} END AS class_id, count(*) AS packets, sum(value) AS bytes FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AND event_type IN ('click', 'view', 'purchase', 'signup', 'error') GROUP BY ALL)
  SELECT c AS class_id, {CLASS_LIST}[c + 1] AS class_name, CASE WHEN c = 0 THEN 'Low' WHEN c IN (7, 10) THEN 'Medium' ELSE 'High' END AS severity, coalesce(n, 0) AS flows, coalesce(packets, 0)::BIGINT AS packets, round(coalesce(n, 0) / greatest(sum(coalesce(n, 0)) OVER (), 1), 6)::DOUBLE AS share
  FROM (SELECT unnest(range(0, 13))::INT AS c) LEFT JOIN (SELECT class_id, count(*) AS n, sum(packets) AS packets FROM flows GROUP BY ALL) ON c = class_id"""


@R.add(FLAGSHIP_SQL)
def class_overview(spark, d):
    """Flows of each of the 13 classes, zeros included: label map, class filter, clean-up, flow aggregation, share and
    severity.  One scan; the class table has 13 rows."""
    from ..operators.clean import drop_invalid

    mapped = taxonomy.map_labels(table(spark, d, "events"), {k: taxonomy.CLASSES[i] for k, i in EVENT_CLASSES.items()}, "event_type")
    valid = drop_invalid(taxonomy.keep_classes(mapped, taxonomy.CLASSES), ("value",))
    flows = valid.groupBy("user_id", "final_label").agg(F.count(F.lit(1)).alias("packets"), F.sum("value").alias("bytes"))
    by_class = flows.groupBy(F.col("final_label").alias("class_name")).agg(F.count(F.lit(1)).alias("flows"), F.sum("packets").alias("packets"))
    full = taxonomy.class_dim(spark).join(by_class, "class_name", "left").withColumns({"flows": F.coalesce("flows", F.lit(0)), "packets": F.coalesce("packets", F.lit(0))})
    share = F.col("flows") / F.greatest(F.sum("flows").over(Window.partitionBy()), F.lit(1))
    return full.select("class_id", "class_name", severity(F.col("class_id")).alias("severity"), "flows", "packets", F.round(share, 6).alias("share"))
