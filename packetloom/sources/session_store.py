"""Sessions, flows and alerts as three Parquet tables, which change as one by a log of commits.

Each attempt to insert a session writes its rows under a number of its own; one line of the log then makes them visible.  Readers
join the log and see of each session the attempt that was committed first: a failed attempt is invisible, a repeated one harmless."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions as ops
from .files import exists

TABLES = ("sessions", "session_flows", "session_alerts")
_LOG = "session_id string, attempt string, committed_at timestamp"


class SessionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _commits(self) -> DataFrame:
        """session_id, attempt: the attempt of each session that counts."""
        log = self.spark.read.schema(_LOG).parquet(self._path("commits")) if exists(self.spark, self._path("commits")) else self.spark.createDataFrame([], _LOG)
        return log.groupBy("session_id").agg(F.min_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))

    def _attempt(self, session_id: str) -> str | None:
        found = self._commits().where(F.col("session_id") == session_id).first()
        return found["attempt"] if found else None

    def read(self, name: str, session_id: str | None = None) -> DataFrame:
        """A table as committed; of one session only its own folder is read."""
        rows = self.spark.read.parquet(self._path(name)).withColumns({c: F.col(c).cast("string") for c in ("session_id", "attempt")})
        if session_id is not None:
            return rows.where((F.col("session_id") == session_id) & (F.col("attempt") == (self._attempt(session_id) or ""))).drop("attempt")
        return rows.join(self._commits(), ["session_id", "attempt"], "left_semi").drop("attempt")

    def write(self, session_id: str, flows: DataFrame, alerts: DataFrame, source: str = "csv") -> str:
        """The rows of a new attempt in all tables, which nobody sees yet; its number."""
        attempt = uuid.uuid4().hex
        own = {"session_id": F.lit(session_id), "attempt": F.lit(attempt)}

        def append(df: DataFrame, name: str) -> None:
            df.withColumns(own).write.mode("append").partitionBy("session_id", "attempt").parquet(self._path(name))

        judged = ops.judged(ops.number_flows(flows.withColumn("session_id", F.lit(session_id)), "session_id", *[c for c in ("start_time", "src_ip", "dst_ip") if c in flows.columns]))
        append(judged, "session_flows")
        append(alerts, "session_alerts")
        written = self.spark.read.parquet(self._path("session_flows")).where((F.col("session_id") == session_id) & (F.col("attempt") == attempt))
        append(ops.session_summary(written.withColumn("session_id", F.lit(session_id)), "session_id").withColumns({"created_at": F.current_timestamp(), "source": F.lit(source)}), "sessions")
        return attempt

    def commit(self, session_id: str, attempt: str) -> None:
        row = self.spark.range(1).select(F.lit(session_id).alias("session_id"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("committed_at"))
        row.coalesce(1).write.mode("append").parquet(self._path("commits"))

    def create(self, session_id: str, flows: DataFrame, alerts: DataFrame, source: str = "csv") -> str:
        """Inserts a session, unless it is there already."""
        if self._attempt(session_id) is None:
            self.commit(session_id, self.write(session_id, flows, alerts, source))
        return session_id

    def list(self, n: int = ops.RECENT) -> DataFrame:
        return ops.recent(self.read("sessions"), n=n)

    def get(self, session_id: str) -> DataFrame:
        return ops.nested(*(self.read(name, session_id) for name in TABLES), "session_id", "flow_index", "alert_id")

    def latest(self) -> DataFrame:
        return ops.latest(self.read("sessions"))

    def purge(self) -> None:
        """Empties the log: all sessions are gone at once."""
        self.spark.createDataFrame([], _LOG).write.mode("overwrite").parquet(self._path("commits"))
