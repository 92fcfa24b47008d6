"""Row clean-up and column selection before training."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_invalid, to_feature

# --- fixed values --------------------------------------------------------------------------------
ARP_COLUMNS = (
    "frame_number", "frame_time_delta", "arp_opcode", "tcp_seq", "tcp_hdr_len", "data_len", "icmp_type",
    "tcp_flag_fin", "tcp_flag_syn", "tcp_flag_rst", "tcp_flag_psh", "tcp_flag_ack", "final_label",
)
LABEL_ALIASES = ("attack", "attack_type", "attack_cat", "category", "sub_cat", "label_name", "label", "target")
ORIGINAL_LABELS = ("label", "Label", "label_name", "Label_Name")
NOT_FEATURES = ("final_label", "Label", "label", "label_name", "Label_Name", "hash", "__index_level_0__")
SUSPICIOUS = ("ip", "timestamp", "time", "id", "port")
CONSTANT_ZERO = (
    "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags", "CWE Flag Count", "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk",
    "Fwd Avg Bulk Rate", "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
)


def numeric_columns(df: DataFrame, besides: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in besides]


def any_invalid(columns: Sequence[str]):
    return reduce(lambda a, b: a | b, [is_invalid(F.col(f"`{c}`")) for c in columns], F.lit(False))


def drop_invalid(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose numeric columns are neither null nor NaN nor infinite."""
    return df.where(~any_invalid(numeric_columns(df) if columns is None else columns))


def as_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns of double become float32 with one zero; integers stay."""
    floating = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))}
    return df.withColumns({c: to_feature(F.col(f"`{c}`")) for c in columns if c in floating})


def drop_labels(df: DataFrame, keep: Sequence[str] = ("final_label",)) -> DataFrame:
    return df.drop(*[c for c in df.columns if c in ORIGINAL_LABELS and c not in keep])


def arp_columns(df: DataFrame) -> DataFrame:
    """Only the permitted ARP columns; hardware addresses never."""
    return df.select(*[f"`{c}`" for c in df.columns if c in ARP_COLUMNS and "mac" not in c.lower()])


def _is_address(name: str) -> bool:
    low = name.lower()
    return "mac" in low or "ip" in low and ("src" in low or "dst" in low)


def fiveg_columns(df: DataFrame) -> DataFrame:
    """All columns but addresses and label aliases; final_label stays."""
    return df.select(*[f"`{c}`" for c in df.columns if c == "final_label" or not (_is_address(c) or c.lower() in LABEL_ALIASES)])


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are neither targets nor addresses."""
    return [c for c in numeric_columns(df, NOT_FEATURES) if not _is_address(c)]


def suspicious_columns(columns: Sequence[str], target: str | None = None) -> list[str]:
    """Names but the target's that hold an identifier's word anywhere, as substrings."""
    return [c for c in columns if c != target and any(w in c.lower() for w in SUSPICIOUS)]


def clean_funnel(df: DataFrame, label: str, columns: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """One row: initial, mapped, dropped and clean rows, in one pass; label is the mapped class."""
    mapped = F.coalesce(F.col(label).isin(*classes), F.lit(False))
    bad = any_invalid(columns)
    return df.agg(
        F.count(F.lit(1)).alias("initial_rows"), F.count_if(mapped).alias("mapped_rows"),
        F.count_if(mapped & bad).alias("invalid_rows"), F.count_if(mapped & ~bad).alias("clean_rows"),
    )


def representation(df: DataFrame, name: str = "all_77") -> DataFrame:
    """The columns of a feature representation: all_77, curated_subset or engineered."""
    from .features import engineered

    if name == "all_77":
        return df
    if name not in ("curated_subset", "engineered"):
        raise ValueError(f"unknown representation: {name}")
    return (engineered(df) if name == "engineered" else df).drop(*CONSTANT_ZERO)
