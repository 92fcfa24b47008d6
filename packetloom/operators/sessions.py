"""Analysis sessions, their flows and alerts, dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import is_threat, severity
from .eve import class_name

PAGE, RECENT, TOP = 8, 15, 5


def session_id(created: Column) -> Column:
    return F.concat(F.lit("SES-"), F.date_format(created, "yyyyMMdd-HHmmss"))


def number_flows(flows: DataFrame, session: str, *order: str) -> DataFrame:
    """Adds flow_index (from 1) and flow_id within a session."""
    out = flows.withColumn("flow_index", F.row_number().over(Window.partitionBy(session).orderBy(*order)))
    return out.withColumn("flow_id", F.format_string("%s-F%04d", F.col(session).cast("string"), F.col("flow_index")))


def judged(flows: DataFrame, class_id: str = "canonical_id") -> DataFrame:
    """Adds class_name, severity and is_threat."""
    c = F.col(class_id)
    return flows.withColumns({"class_name": class_name(c), "severity": severity(c), "is_threat": is_threat(c)})


def session_summary(flows: DataFrame, session: str) -> DataFrame:
    """Totals of each session, detection rate in percent, and maps of protocol and attack counts."""
    totals = flows.groupBy(session).agg(F.count(F.lit(1)).alias("total_flows"), F.count_if("is_threat").alias("threats"), F.count_if(~F.col("is_threat")).alias("benign"))
    totals = totals.withColumn("detection_rate", F.round(F.col("threats") * 100.0 / F.col("total_flows"), 2))

    def counts(by: str, name: str, rows: DataFrame) -> DataFrame:
        each = rows.groupBy(session, by).agg(F.count(F.lit(1)).alias("n"))
        return each.groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(name))  # a protocol or class each

    out = totals.join(counts("proto", "protocols", flows), session, "left").join(counts("class_name", "attacks", flows.where("is_threat")), session, "left")
    return out.withColumn("attacks", F.coalesce("attacks", F.create_map().cast("map<string,bigint>")))


def top_counts(df: DataFrame, by: str, n: int = TOP) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(n)


def recent(sessions: DataFrame, created: str = "created_at", key: str = "session_id", n: int = RECENT) -> DataFrame:
    return sessions.orderBy(F.desc(created), key).limit(n)


def latest(sessions: DataFrame, created: str = "created_at", key: str = "session_id") -> DataFrame:
    return recent(sessions, created, key, 1)


def nested(sessions: DataFrame, flows: DataFrame, alerts: DataFrame, key: str, flow_order: str, alert_order: str) -> DataFrame:
    """Sessions with their flows and alerts as ordered arrays.  Meant for chosen sessions: only their rows are gathered, and each
    becomes one row."""
    gather = lambda df, order, name: df.join(sessions.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c not in (key, order)]))).alias(name))
    out = sessions.join(gather(flows, flow_order, "flows"), key, "left").join(gather(alerts, alert_order, "alerts"), key, "left")
    return out


def alerts_of(flows: DataFrame, engine_alerts: DataFrame, session: str) -> DataFrame:
    """One alert for each threat flow and one for each engine alert (High, confidence 1; TCP unless its protocol is UDP)."""
    ours = flows.where("is_threat").select(F.col(session).alias("session_id"), F.concat(F.lit("ALT-"), F.col("flow_id")).alias("alert_id"), F.lit("AI model").alias("engine"), "canonical_id", "class_name", "severity", "confidence", "src_ip", "dst_ip", F.col("proto_number").alias("proto"))
    theirs = engine_alerts.select(
        F.col(session).alias("session_id"), F.concat(F.lit("ALT-"), F.col("alert_key").cast("string")).alias("alert_id"), F.lit("Signature engine").alias("engine"), "canonical_id", F.col("canonical_class").alias("class_name"),
        F.lit("High").alias("severity"), F.lit(1.0).alias("confidence"), "src_ip", F.col("dest_ip").alias("dst_ip"), F.when(F.upper("proto") == "UDP", 17).otherwise(6).alias("proto"),
    )
    return ours.unionByName(theirs)


def filter_alerts(alerts: DataFrame, category: str | None = None, engine: str | None = None, severity: str | None = None, text: str | None = None) -> DataFrame:
    """Each given filter: category equal, engine containing (less ' model'), severity equal, any column containing text."""
    out = alerts
    if category:
        out = out.where(F.col("class_name") == category)
    if engine:
        out = out.where(F.lower("engine").contains(engine.replace(" model", "").lower()))
    if severity:
        out = out.where(F.col("severity") == severity)
    if text:
        every = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in alerts.columns]))
        out = out.where(every.contains(text.lower()))
    return out


def page(df: DataFrame, number: int, *order, size: int = PAGE) -> DataFrame:
    """Rows of a page (from 1): only as many rows as come before it are sorted out."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def kpis(flows: DataFrame) -> DataFrame:
    """One row: flows, threats and their percentage, distinct sources, destinations and classes."""
    return flows.agg(
        F.count(F.lit(1)).alias("total_flows"), F.count_if("is_threat").alias("threats"), F.round(F.coalesce(F.try_divide(F.count_if("is_threat") * 100.0, F.count(F.lit(1))), F.lit(0.0)), 2).alias("threat_percent"),
        F.count_distinct("src_ip").alias("sources"), F.count_distinct("dst_ip").alias("destinations"), F.count_distinct(F.when(F.col("is_threat"), F.col("canonical_id"))).alias("attack_classes"),
    )
