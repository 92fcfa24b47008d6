"""Column expressions of the domain: DNS text, TCP flags and ports, protocol and severity, numeric clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------------------------
PROTOCOL_NAMES = {1: "ICMP", 6: "TCP", 17: "UDP", 2054: "ARP"}
MORE_PROTOCOL_NAMES = {47: "GRE", 50: "ESP", 58: "ICMPv6"}
HIGH_SEVERITY_IDS = (1, 2, 3, 4, 5, 6, 8, 9, 11, 12)
FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20, "ece": 0x40, "cwr": 0x80}
SERVICE_PORTS = {"HTTP": (80,), "HTTPS": (443,), "DNS": (53,), "Telnet": (23,), "SMTP": (25,), "SSH": (22,)}
LIVE_SERVICE_PORTS = SERVICE_PORTS | {"HTTP": (80, 8080), "SMTP": (25, 587), "IRC": (6667,), "DHCP": (67, 68)}


# --- DNS text ------------------------------------------------------------------------------------
def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters in bits; empty text: 0."""
    n = F.length(text)
    chars = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    shares = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def dns_labels(query: Column) -> Column:
    return F.split(query, r"\.")


def dns_features(query: Column) -> dict[str, Column]:
    """The nine features of a query name; a null name counts as empty."""
    q = F.coalesce(query, F.lit(""))
    sizes = F.transform(dns_labels(q), lambda x: F.length(x))
    count = lambda pattern: F.regexp_count(q, F.lit(pattern)).cast("int")
    return {
        "query_length": F.length(q),
        "num_dots": count(r"\."),
        "num_subdomains": count(r"\.") + 1,
        "max_label_length": F.array_max(sizes),
        "avg_label_length": F.aggregate(sizes, F.lit(0), lambda a, b: a + b) / F.size(sizes),
        "digit_count": count(r"[0-9]"),
        "alpha_count": count(r"[a-zA-Z]"),
        "special_character_count": count(r"[^a-zA-Z0-9.]"),
        "entropy": entropy(q),
    }


def live_dns_features(query: Column) -> dict[str, Column]:
    """What the live path computes of a query name: its special characters are those that are neither letters nor
    digits of any script, and entropy has four decimals."""
    q = F.coalesce(query, F.lit(""))
    return {
        "query_length": F.length(q),
        "subdomain_count": F.size(dns_labels(q)),
        "special_character_count": F.regexp_count(q, F.lit(r"[^\p{L}\p{N}.]")).cast("int"),
        "entropy": F.round(entropy(q), 4),
    }


def dns_name(name: Column) -> Column:
    """A name as it is stored: without dots at its end."""
    return F.rtrim(name, F.lit("."))


# --- packets -------------------------------------------------------------------------------------
def has_flag(flags: Column, name: str) -> Column:
    return flags.bitwiseAND(F.lit(FLAG_BITS[name])) != 0


def port_indicator(src: Column, dst: Column, ports: tuple[int, ...]) -> Column:
    return F.when(src.isin(*ports) | dst.isin(*ports), 1.0).otherwise(0.0)


def indicator(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def protocol_name(proto: Column, fallback: Column | None = None, names: dict[int, str] = PROTOCOL_NAMES) -> Column:
    """Name of a protocol number; others: fallback, or the number as text."""
    out = F
    for number, name in names.items():
        out = out.when(proto == number, name)
    return out.otherwise(proto.cast("string") if fallback is None else fallback)


def display_protocol(proto: Column) -> Column:
    return protocol_name(proto, F.concat(F.lit("IP-"), proto.cast("string")), PROTOCOL_NAMES | MORE_PROTOCOL_NAMES)


# --- classes -------------------------------------------------------------------------------------
def severity(class_id: Column) -> Column:
    return F.when(class_id == 0, "Low").when(class_id.isin(*HIGH_SEVERITY_IDS), "High").otherwise("Medium")


def is_threat(class_id: Column) -> Column:
    return class_id != 0


# --- numbers -------------------------------------------------------------------------------------
def is_invalid(c: Column) -> Column:
    """Null, NaN or infinite."""
    d = c.cast("double")
    return c.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))


def to_feature(c: Column) -> Column:
    """float32 with one zero only."""
    f = c.cast("float")
    return F.when(f == 0, F.lit(0.0).cast("float")).otherwise(f)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def row_digest(*columns: str) -> Column:
    """SHA-256 of a row's features, for collision checks.  Each value goes with its length, so that no two rows read the same."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]), 256)
