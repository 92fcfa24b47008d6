"""Row-wise derived features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dns_features

FWD, BWD = "Total Fwd Packets", "Total Backward Packets"
FWD_BYTES, BWD_BYTES = "Fwd Packets Length Total", "Bwd Packets Length Total"


def _f(name: str) -> Column:
    return F.col(f"`{name}`").cast("float")


def _per(a: str, b: str) -> Column:
    """a / (b + 1) in float32."""
    return (_f(a) / (_f(b) + F.lit(1.0).cast("float"))).cast("float")


#: Name, the columns that it needs, and its value.
ENGINEERED = (
    ("fwd_bwd_pkt_ratio", (FWD, BWD), lambda: _per(FWD, BWD)),
    ("total_flow_packets", (FWD, BWD), lambda: _f(FWD) + _f(BWD)),
    ("fwd_bwd_byte_ratio", (FWD_BYTES, BWD_BYTES), lambda: _per(FWD_BYTES, BWD_BYTES)),
    ("total_flow_bytes", (FWD_BYTES, BWD_BYTES), lambda: _f(FWD_BYTES) + _f(BWD_BYTES)),
    ("bytes_per_fwd_pkt", (FWD_BYTES, FWD), lambda: _per(FWD_BYTES, FWD)),
    ("bytes_per_bwd_pkt", (BWD_BYTES, BWD), lambda: _per(BWD_BYTES, BWD)),
    ("hdr_payload_ratio_fwd", ("Fwd Header Length", FWD_BYTES), lambda: _per("Fwd Header Length", FWD_BYTES)),
    ("flow_iat_spread", ("Flow IAT Max", "Flow IAT Min"), lambda: _f("Flow IAT Max") - _f("Flow IAT Min")),
)


def engineered(df: DataFrame) -> DataFrame:
    """Adds each engineered feature whose inputs are there."""
    have = set(df.columns)
    return df.withColumns({name: value() for name, needs, value in ENGINEERED if have.issuperset(needs)})


def query_column(columns: list[str]) -> str:
    """Where a query name stands: `query`, else the second column, else the first."""
    return "query" if "query" in columns else columns[1] if len(columns) > 1 else columns[0]


def with_dns_features(df: DataFrame, query: str | None = None, drop: bool = True) -> DataFrame:
    """The nine DNS features for the query column, which goes unless drop is false."""
    name = query or query_column(df.columns)
    out = df.withColumns(dns_features(F.col(f"`{name}`").cast("string")))
    return out.drop(name) if drop else out
