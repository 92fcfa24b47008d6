"""Structured Streaming: live flows, immediate events, rates, ingest, counters.

Times are event times with a watermark; what comes later than LATE is dropped."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import flows as flow_ops
from ..operators import rules as rule_ops
from ..operators.score import score_mixed
from ..sources.files import exists

LATE, TRIGGER, MAX_EVENTS, RECENT_EVENTS = "10 seconds", "2 seconds", 20, 500
ONLINE_SECONDS = 15
#: Attempts of a delivery, and the seconds by which the pause after each grows.
TRIES, PAUSE = 3, 0.5


def packet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = MAX_EVENTS) -> DataFrame:
    """Packet rows that arrive as Parquet files; event_time is a timestamp, as a watermark needs one."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return rows.withColumn("event_time", F.timestamp_seconds(F.col("ts"))).withWatermark("event_time", LATE)


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """Event record lines that arrive as text files."""
    return spark.readStream.text(path)


def session_flows(packets: DataFrame, idle: str = "5 seconds") -> DataFrame:
    """Flows by session windows of event time.  Unlike the batch twin, a gap of exactly idle does not end a flow, and no
    cap applies; capped_flows has both."""
    keyed = flow_ops.with_flow_key(packets.where(F.col("proto") != flow_ops.ARP))
    grouped = keyed.groupBy(*flow_ops.KEY, F.session_window("event_time", idle).alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("packet_count"), F.sum("frame_len").alias("byte_count"), F.min("ts").alias("start_time"), F.max("ts").alias("end_time")).drop("w")


_FLOW = "ip_a string, ip_b string, port_a int, port_b int, proto int, packet_count long, byte_count long, start_time double, end_time double, fwd_count long"
_HELD = "ts double, seq long, frame_len long, is_fwd boolean"
_OPEN = "n long, bytes long, begin double, end double, fwd long, first_fwd boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cut_flows(ts: np.ndarray, idle: float, cap: int, n_open: int = 0, last: float | None = None) -> np.ndarray:
    """Places among sorted packets where a flow begins; a flow ends by a gap of idle or with cap packets.  n_open, last: packets
    and end of the flow that is open before them."""
    gap = np.append(np.inf if last is None else ts[0] - last, np.diff(ts)) >= idle
    begins = []
    runs = [*np.flatnonzero(gap).tolist(), len(ts)]
    if runs[0] > 0:  # the open flow goes on, up to its cap
        begins += range(max(0, cap - n_open), runs[0], cap)
    for a, b in zip(runs, runs[1:]):
        begins += range(a, b, cap)
    return np.array(begins, np.int64)


class FlowTable(StatefulProcessor):
    """Of each key the packets that the watermark has not passed yet, and the counters of the open flow.  Packets are released by
    the watermark, in order of time and arrival, whatever the micro-batch in which they came."""

    def __init__(self, idle: float, cap: int):
        self.idle, self.cap = idle, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", _HELD)
        self.open = handle.getValueState("open", _OPEN)

    def _wake(self, at: float) -> None:
        """A timer at a time in seconds, unless one is set for then or before."""
        ms = math.floor(at * 1000) + 1
        timers = list(self.handle.listTimers())
        if not timers or min(timers) > ms:
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = float("inf")
        for some in rows:
            self.held.appendList(list(zip(some["ts"].astype(float), some["seq"].astype(int), some["frame_len"].astype(int), some["is_fwd"].astype(bool), strict=True)))
            first = min(first, float(some["ts"].min()))
        self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs() / 1000
        held = pd.DataFrame(list(self.held.get()), columns=["ts", "seq", "frame_len", "is_fwd"])
        late = held["ts"] >= watermark  # their place is not settled yet
        ready, rest = held[~late].sort_values(["ts", "seq"]), held[late]
        n, size, begin, end, fwd, first_fwd = self.open.get() if self.open.exists() else (0, 0, 0.0, 0.0, 0, True)
        done = []

        def close() -> None:
            done.append((*key, n, size, begin, end, fwd if first_fwd else n - fwd))

        if len(ready):
            ts, sizes, ahead = (ready[c].to_numpy() for c in ("ts", "frame_len", "is_fwd"))
            begins = cut_flows(ts, self.idle, self.cap, n, end if n else None)
            cuts = [0, *(b for b in begins.tolist() if b), len(ts)]
            for a, b in zip(cuts, cuts[1:]):
                if a in begins:
                    if n:
                        close()
                    n, size, begin, fwd, first_fwd = 0, 0, float(ts[a]), 0, bool(ahead[a])
                n, size, fwd, end = n + b - a, size + int(sizes[a:b].sum()), fwd + int(ahead[a:b].sum()), float(ts[b - 1])
        if n and end + self.idle < watermark and (rest.empty or rest["ts"].min() - end >= self.idle):
            close()
            n = 0
        self.held.clear()
        if len(rest):
            self.held.appendList([(float(a), int(b), int(c), bool(d)) for a, b, c, d in rest.itertuples(index=False)])
        if n:
            self.open.update((int(n), int(size), float(begin), float(end), int(fwd), bool(first_fwd)))
        else:
            self.open.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(rest) or n:
            self._wake(max(watermark, min([*rest["ts"].tolist(), *([end + self.idle] if n else [])])))
        yield pd.DataFrame(done, columns=[x.split()[0] for x in _FLOW.split(", ")])

    def close(self) -> None:
        pass


def capped_flows(packets: DataFrame, idle: float = flow_ops.IDLE_SECONDS, cap: int = flow_ops.MAX_PACKETS) -> DataFrame:
    """Live flow table, as the batch twin has it, from packets in any order within the watermark.  Its state needs Spark's RocksDB
    store, which is chosen for the session."""
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = flow_ops.with_flow_key(packets.where(F.col("proto") != flow_ops.ARP))
    rows = keyed.select(*flow_ops.KEY, "ts", F.col("seq").cast("long").alias("seq"), F.col("frame_len").cast("long").alias("frame_len"), "is_fwd", "event_time")
    return rows.groupBy(*flow_ops.KEY).transformWithStateInPandas(FlowTable(idle, cap), _FLOW, "append", "eventTime")


def arp_events(packets: DataFrame) -> DataFrame:
    return flow_ops.arp_events(packets)


def dns_events(packets: DataFrame) -> DataFrame:
    """DNS queries at once, with all nine features."""
    from ..functions import dns_features

    return packets.where(F.col("dns_qname").isNotNull()).withColumns(dns_features(F.col("dns_qname")))


def rate_alerts(packets: DataFrame, rule: rule_ops.Rule) -> DataFrame:
    """A rate rule over tumbling windows of event time."""
    window = F.window("event_time", f"{rule.seconds} seconds").alias("w")
    counted = packets.where(rule.predicate).groupBy(window, F.col(rule.by).alias("address")).agg(F.count(F.lit(1)).alias("hits"))
    return counted.where(F.col("hits") >= rule.count).select(F.lit(rule.sid).alias("sid"), F.lit(rule.class_id).alias("class_id"), "address", F.col("w.start").alias("window_start"), "hits")


def ingest(records: DataFrame, scorers: dict[str, Callable[[DataFrame], DataFrame]], needs: dict[str, tuple[str, ...]]) -> DataFrame:
    """Scores a batch of records; one that lacks a feature of its specialist gets status INCOMPLETE_FEATURES."""
    from ..operators.taxonomy import route_row

    keys = F.map_keys("features")
    complete: Column = F.lit(True)
    for name, features in needs.items():
        lacking = F.size(F.array_except(F.array(*[F.lit(f) for f in features]), keys)) > 0
        complete = complete & ~(F.coalesce(route_row(keys) == name, F.lit(False)) & lacking)
    scored = score_mixed(records.where(complete), scorers)
    rest = records.where(~complete).select("*", route_row(keys).alias("specialist"), F.lit(None).cast("int").alias("canonical_id"), F.lit(None).cast("double").alias("confidence"), F.lit("INCOMPLETE_FEATURES").alias("status"))
    return scored.unionByName(rest)


def deliver(records: DataFrame, path: str, checkpoint: str, scorers, needs, once: bool = False):
    """Scores each micro-batch into path.  A batch goes to a folder of its own id, so that a repeated one replaces itself:
    at least once in, exactly once out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest(batch, scorers, needs).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def transmit(send: Callable[[dict], int], sensor: str, events: list[dict], now: Callable[[], float] = time.time, wait: Callable[[float], None] = time.sleep) -> bool:
    """Sends one bounded batch of a sensor: TRIES times at most, with growing pauses; a rejected key (401, 403) ends it at
    once.  send: takes the payload and returns a status, or raises.  Whether it was accepted; no events are."""
    if not events:
        return True
    payload = {"sensor_id": sensor, "timestamp": now(), "batch_size": len(events), "events": events}
    for attempt in range(1, TRIES + 1):
        try:
            status = send(payload)
        except OSError:
            status = None
        if status == 200:
            return True
        if status in (401, 403):
            return False
        wait(PAUSE * attempt)
    return False


def post(events: DataFrame, send: Callable[[dict], int], sensor: str, requeue: str, checkpoint: str, size: int = MAX_EVENTS, once: bool = False):
    """Sends each micro-batch's events (JSON text, column value) in batches of size, from as many tasks as it has partitions.  What
    isn't accepted is written to requeue and sent again with the next micro-batch: every event arrives at least once."""

    def sent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for i in range(0, len(rows), size):
                some = rows.iloc[i : i + size]
                if not transmit(send, sensor, [json.loads(v) for v in some["value"]]):
                    yield some

    def run(batch: DataFrame, batch_id: int) -> None:
        waiting, rows = f"{requeue}/batch={batch_id - 1}", batch.select("value")
        if exists(batch.sparkSession, waiting):
            rows = rows.unionByName(batch.sparkSession.read.schema("value string").parquet(waiting))
        rows.mapInPandas(sent, "value string").write.mode("overwrite").parquet(f"{requeue}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def counters(events: DataFrame) -> DataFrame:
    """Running totals by event type, for complete mode."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def recent_events(events: DataFrame, order: str, n: int = RECENT_EVENTS) -> DataFrame:
    """The last n events of a table."""
    return events.orderBy(F.desc(order)).limit(n)


def sensor_status(heartbeats: DataFrame, now: Column) -> DataFrame:
    """sensor, last_seen, status: ONLINE if heard of within ONLINE_SECONDS before now, a constant or a column."""
    last = heartbeats.groupBy("sensor").agg(F.max("seen_at").alias("last_seen"), F.coalesce(F.max(now), F.current_timestamp()).alias("_now"))
    age = F.unix_micros("_now") - F.unix_micros("last_seen")
    return last.withColumn("status", F.when(age <= ONLINE_SECONDS * 1_000_000, "ONLINE").otherwise("OFFLINE")).drop("_now")
