"""Domain views over the test tables, as DataFrames and as the same expressions in SQL.

All derive from whole tables by expressions; `SQL` holds a common table expression for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.taxonomy import label_map
from ..sources.files import table

#: Raw labels of the lineitem view, by return flag.
RAW_LABELS = {"A": "DoS attacks-Hulk", "N": " Benign ", "R": "Bot"}
FEATURES = ("l_quantity", "l_discount", "l_tax", "l_suppkey")
CLASSES = ("Benign", "DoS", "Botnet")
#: Class of an event type; clicks count as benign.
EVENT_CLASSES = {"click": 0, "view": 0, "purchase": 5, "signup": 10, "error": 2}
PROTOCOLS = {"click": 6, "view": 6, "purchase": 6, "signup": 17, "error": 1}
PORTS = (80, 443, 53, 22, 23, 25, 6667, 8080)

SQL: dict[str, str] = {}


def sql(query: str, *names: str) -> str:
    """A query with the views that it names in front."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + query


# --- packets from events ---------------------------------------------------------------------------
def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    inside, outside = F.concat(F.lit("10.0.0."), (F.col("user_id") % 20).cast("string")), F.concat(F.lit("10.0.1."), (F.col("user_id") * 7 % 13).cast("string"))
    back = F.col("event_id") % 3 == 0
    service, client = F.get(F.array(*[F.lit(p) for p in PORTS]), (F.col("user_id") % 8).cast("int")), (40000 + F.col("user_id") % 5).cast("int")
    proto = F
    for kind, number in PROTOCOLS.items():
        proto = proto.when(F.col("event_type") == kind, number)
    return e.select(
        F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("ts"), F.when(back, outside).otherwise(inside).alias("src_ip"), F.when(back, inside).otherwise(outside).alias("dst_ip"),
        F.when(back, service).otherwise(client).alias("src_port"), F.when(back, client).otherwise(service).alias("dst_port"), proto.otherwise(6).alias("proto"),
        (F.floor("value").cast("int") + 40).alias("frame_len"), (F.col("event_id") % 256).cast("int").alias("tcp_flags"), (5 + F.col("event_id") % 3).cast("int").alias("ihl"),
    )


SQL["packets"] = f"""SELECT event_id AS seq, epoch_us(ts) / 1000000 AS ts,
  CASE WHEN event_id % 3 = 0 THEN '10.0.1.' || (user_id * 7 % 13) ELSE '10.0.0.' || (user_id % 20) END AS src_ip,
  CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 20) ELSE '10.0.1.' || (user_id * 7 % 13) END AS dst_ip,
  CAST(CASE WHEN event_id % 3 = 0 THEN {list(PORTS)}[user_id % 8 + 1] ELSE 40000 + user_id % 5 END AS INT) AS src_port,
  CAST(CASE WHEN event_id % 3 = 0 THEN 40000 + user_id % 5 ELSE {list(PORTS)}[user_id % 8 + 1] END AS INT) AS dst_port,
  CASE event_type {" ".join(f"WHEN '{k}' THEN {n}" for k, n in PROTOCOLS.items())} ELSE 6 END AS proto,
  CAST(floor(value) AS INT) + 40 AS frame_len, CAST(event_id % 256 AS INT) AS tcp_flags, CAST(5 + event_id % 3 AS INT) AS ihl FROM events"""
SQL["keyed"] = """SELECT *, CASE WHEN swap THEN dst_ip ELSE src_ip END AS ip_a, CASE WHEN swap THEN src_ip ELSE dst_ip END AS ip_b,
  CASE WHEN swap THEN dst_port ELSE src_port END AS port_a, CASE WHEN swap THEN src_port ELSE dst_port END AS port_b, NOT swap AS is_fwd
  FROM (SELECT *, src_ip > dst_ip OR (src_ip = dst_ip AND src_port > dst_port) AS swap FROM packets)"""
KEY = "ip_a, ip_b, port_a, port_b, proto"


# --- labelled flows from lineitem ------------------------------------------------------------------
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, four features, raw label; a few values are missing, infinite or negative zero."""
    raw = F
    for flag, label in RAW_LABELS.items():
        raw = raw.when(F.col("l_returnflag") == flag, label)
    n = F.col("l_orderkey")
    quantity = F.when(n % 97 == 0, F.lit(float("nan"))).when(n % 89 == 0, F.lit(float("inf"))).when(n % 83 == 0, F.lit(None)).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select(
        (n * 8 + F.col("l_linenumber")).alias("key"), quantity.alias("l_quantity"), F.when((F.col("l_discount") == 0) & (n % 2 == 0), F.lit(-0.0)).otherwise(F.col("l_discount")).alias("l_discount"), "l_tax", "l_suppkey",
        F.when(n % 101 == 0, "Unheard").otherwise(raw.otherwise("Benign")).alias("raw_label"),
    )


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled after label mapping, class filter and removal of invalid numbers, as float32 features."""
    from ..operators import clean as ops
    from ..operators import taxonomy

    mapped = taxonomy.map_labels(labelled(spark, sf_dir), label_map("IDS2018"), "raw_label", robust=True)
    return ops.as_features(ops.drop_invalid(taxonomy.keep_classes(mapped, CLASSES), FEATURES), FEATURES)


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RAW_LABELS.items())
SQL["labelled"] = f"""SELECT l_orderkey * 8 + l_linenumber AS key,
  CASE WHEN l_orderkey % 97 = 0 THEN 'NaN'::DOUBLE WHEN l_orderkey % 89 = 0 THEN 'Infinity'::DOUBLE WHEN l_orderkey % 83 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  l_discount, l_tax, l_suppkey, CASE WHEN l_orderkey % 101 = 0 THEN 'Unheard' ELSE CASE l_returnflag {_CASE} ELSE 'Benign' END END AS raw_label FROM lineitem"""
SQL["mapped"] = "SELECT *, CASE trim(raw_label) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in label_map("IDS2018").items()) + " END AS final_label FROM labelled"
SQL["clean"] = """SELECT key, l_quantity::FLOAT AS l_quantity, l_discount::FLOAT AS l_discount, l_tax::FLOAT AS l_tax, l_suppkey, final_label FROM mapped
  WHERE final_label IN ('Benign', 'DoS', 'Botnet') AND l_quantity IS NOT NULL AND NOT isnan(l_quantity) AND NOT isinf(l_quantity)"""
CLEAN = ("labelled", "mapped", "clean")
VECTOR = ", ".join(FEATURES)


# --- predictions and posteriors from events --------------------------------------------------------
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(n.alias("key"), (n * 7 % 13).cast("int").alias("true_id"), F.when(n % 5 < 3, n * 7 % 13).otherwise(n * 3 % 11).cast("int").alias("pred_id"), (F.col("value") / 1000).alias("seconds"))


SQL["predictions"] = "SELECT event_id AS key, CAST(event_id * 7 % 13 AS INT) AS true_id, CAST(CASE WHEN event_id % 5 < 3 THEN event_id * 7 % 13 ELSE event_id * 3 % 11 END AS INT) AS pred_id, value / 1000 AS seconds FROM events"


def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, true_id of 7 classes and a posterior of 7 entries."""
    n = F.col("event_id")
    raw = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (n * (i + 3) % 17 + 1).cast("double"))
    p = table(spark, sf_dir, "events").select(n.alias("key"), (n * 5 % 7).cast("int").alias("true_id"), raw.alias("raw"))
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return p.withColumn("_t", total).select("key", "true_id", F.transform("raw", lambda x: x / F.col("_t")).alias("p"))


SQL["posteriors"] = """SELECT key, true_id, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM (SELECT event_id AS key, CAST(event_id * 5 % 7 AS INT) AS true_id,
  list_transform(range(0, 7), lambda i: CAST(event_id * (i + 3) % 17 + 1 AS DOUBLE)) AS raw FROM events)"""


# --- judged flows of sessions from orders ------------------------------------------------------------
def order_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a flow, its customer as its session."""
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("session"), n.alias("flow"), F.col("o_orderdate").alias("created_at"), (n % 13).cast("int").alias("canonical_id"), F.concat(F.lit("10.1.0."), (n % 50).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.2.0."), (n * 3 % 40).cast("string")).alias("dst_ip"), F.get(F.array(F.lit(6), F.lit(17), F.lit(1), F.lit(58), F.lit(99)), (n % 5).cast("int")).alias("proto_number"), F.round(F.col("o_totalprice") % 1, 4).alias("confidence"),
    )


SQL["order_flows"] = """SELECT o_custkey AS session, o_orderkey AS flow, o_orderdate AS created_at, CAST(o_orderkey % 13 AS INT) AS canonical_id, '10.1.0.' || (o_orderkey % 50) AS src_ip,
  '10.2.0.' || (o_orderkey * 3 % 40) AS dst_ip, [6, 17, 1, 58, 99][o_orderkey % 5 + 1] AS proto_number, round(o_totalprice % 1, 4) AS confidence FROM orders"""
_NAMES = ("Benign", "DDoS", "DoS", "Botnet", "Infiltration", "Brute Force", "Web Attack", "DNS Spoofing", "IP Spoofing", "ARP Spoofing", "Recon / Port Scan", "MITM", "DNS Tunneling")
CLASS_LIST = "[" + ", ".join(f"'{c}'" for c in _NAMES) + "]"
SQL["judged"] = f"""SELECT *, {CLASS_LIST}[canonical_id + 1] AS class_name, CASE WHEN canonical_id = 0 THEN 'Low' WHEN canonical_id IN (7, 10) THEN 'Medium' ELSE 'High' END AS severity, canonical_id <> 0 AS is_threat FROM order_flows"""


# --- event records from events -----------------------------------------------------------------------
SIGNATURES = ("ET SCAN nmap probe", "brute force login", "Mirai botnet beacon", "SQL Injection attempt", "hello world", "DNS Tunnel iodine", "arp poison", "DDoS amplification", "slowloris", "man-in-the-middle")


def eve_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON line for each event; some are blank, malformed or of an unknown type."""
    n = F.col("event_id")
    kind = F.get(F.array(*[F.lit(k) for k in ("alert", "flow", "dns", "http", "tls", "anomaly", "stats", "alert")]), (n % 8).cast("int"))
    signature = F.get(F.array(*[F.lit(s) for s in SIGNATURES]), (n % 10).cast("int"))
    sid = F.when(n % 16 == 0, F.concat(F.lit('"signature_id":'), (9000010 + n % 113).cast("string"), F.lit(","))).otherwise("")
    text = F.concat(
        F.lit('{"event_type":"'), kind, F.lit('","flow_id":'), n.cast("string"), F.lit(',"src_ip":"10.0.0.'), (F.col("user_id") % 20).cast("string"), F.lit('","src_port":'), (40000 + F.col("user_id") % 5).cast("string"),
        F.lit(',"dest_ip":"10.0.1.'), (F.col("user_id") * 7 % 13).cast("string"), F.lit('","dest_port":'), F.get(F.array(*[F.lit(p) for p in PORTS]), (F.col("user_id") % 8).cast("int")).cast("string"), F.lit(',"proto":"TCP"'),
        F.when(kind == "alert", F.concat(F.lit(',"alert":{'), sid, F.lit('"signature":"'), signature, F.lit('","severity":'), (n % 3 + 1).cast("string"), F.lit("}"))).otherwise(""), F.lit("}"),
    )
    return table(spark, sf_dir, "events").select(n, F.when(n % 31 == 0, "  ").when(n % 37 == 0, F.concat(text, F.lit("}{"))).otherwise(text).alias("value"))


SQL["eve_lines"] = f"""SELECT event_id, CASE WHEN event_id % 31 = 0 THEN '  ' WHEN event_id % 37 = 0 THEN line || '}}{{' ELSE line END AS value FROM (
  SELECT event_id, '{{"event_type":"' || kind || '","flow_id":' || event_id || ',"src_ip":"10.0.0.' || (user_id % 20) || '","src_port":' || (40000 + user_id % 5) || ',"dest_ip":"10.0.1.' || (user_id * 7 % 13)
    || '","dest_port":' || {list(PORTS)}[user_id % 8 + 1] || ',"proto":"TCP"' || CASE WHEN kind = 'alert' THEN ',"alert":{{' || CASE WHEN event_id % 16 = 0 THEN '"signature_id":' || (9000010 + event_id % 113) || ',' ELSE '' END
    || '"signature":"' || {list(SIGNATURES)}[event_id % 10 + 1] || '","severity":' || (event_id % 3 + 1) || '}}' ELSE '' END || '}}' AS line
  FROM (SELECT *, ['alert', 'flow', 'dns', 'http', 'tls', 'anomaly', 'stats', 'alert'][event_id % 8 + 1] AS kind FROM events))"""
SQL["records"] = "SELECT event_id, NOT json_valid(value) AS is_corrupt, CASE WHEN json_valid(value) THEN value::JSON END AS r FROM eve_lines WHERE trim(value) <> ''"
EVE = ("eve_lines", "records")


# --- query names from pages --------------------------------------------------------------------------
def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("query"))


SQL["hosts"] = "SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS query FROM pages"
