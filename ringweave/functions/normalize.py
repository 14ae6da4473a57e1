"""Entity normalizers as column expressions (no Python UDF).

``(?U)`` gives the regexes Unicode whitespace and digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringweave.config import MAX_RAW_LENGTH

# fixed value patterns
PHONE_NOISE = r"(?U)[\s\-().]+"
PHONE_SHAPE = r"(?U)^[6-9]\d{9}$"
VPA_SHAPE = r"^[a-z0-9._-]{1,64}@[a-z]{2,16}$"
EMAIL_SHAPE = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"
IPV4_SHAPE = r"^\d{1,3}(\.\d{1,3}){3}$"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(raw: Column) -> Column:
    return F.regexp_replace(raw, EDGE_SPACE, "")


def tidy(raw: Column) -> Column:
    return F.lower(strip(raw))


def bare_phone(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, PHONE_NOISE, ""), r"^\+", "")


def accept_phone(bare: Column) -> Column:
    size = F.length(bare)
    local = (
        F.when((size == 14) & bare.startswith("0091"), F.substring(bare, 5, 10))
        .when((size == 12) & bare.startswith("91"), F.substring(bare, 3, 10))
        .when((size == 11) & bare.startswith("0"), F.substring(bare, 2, 10))
        .otherwise(bare)
    )
    return F.when(local.rlike(PHONE_SHAPE), F.concat(F.lit("+91"), local))


def accept_vpa(value: Column) -> Column:
    return F.when((F.length(value) <= MAX_RAW_LENGTH) & value.rlike(VPA_SHAPE), value)


def accept_device(value: Column) -> Column:
    return F.when(F.length(value).between(1, MAX_RAW_LENGTH), value)


def accept_email(value: Column) -> Column:
    return F.when((F.length(value) <= MAX_RAW_LENGTH) & value.rlike(EMAIL_SHAPE), value)


def normalize_phone(raw: Column) -> Column:
    """Indian mobile number as +91XXXXXXXXXX, or null."""
    return accept_phone(bare_phone(raw))


def normalize_vpa(raw: Column) -> Column:
    return accept_vpa(tidy(raw))


def normalize_device(raw: Column) -> Column:
    return accept_device(tidy(raw))


def normalize_email(raw: Column) -> Column:
    return accept_email(tidy(raw))


def normalize_ip(raw: Column) -> Column:
    """IPv4 with every octet at most 255; leading zeros are kept."""
    value = strip(raw)
    octets_ok = F.forall(F.split(value, r"\."), lambda octet: octet.try_cast("int") <= 255)
    return F.when(value.rlike(IPV4_SHAPE) & octets_ok, value)


def with_entities(events: DataFrame) -> DataFrame:
    """Add upi_entity, phone_entity, device_entity and email_entity.

    Two projections, so that every raw value is cleaned once and only once.
    """
    cleaned = events.select(
        "*",
        tidy(F.col("upi_vpa")).alias("_upi"),
        bare_phone(F.col("phone")).alias("_phone"),
        tidy(F.col("device_id")).alias("_device"),
        tidy(F.col("email")).alias("_email"),
    )
    return cleaned.select(
        *events.columns,
        accept_vpa(F.col("_upi")).alias("upi_entity"),
        accept_phone(F.col("_phone")).alias("phone_entity"),
        accept_device(F.col("_device")).alias("device_entity"),
        accept_email(F.col("_email")).alias("email_entity"),
    )


def typed_node_id(node_type: Column | str, value: Column) -> Column:
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    return F.concat_ws(":", kind, value)


def node_value(node: Column) -> Column:
    """Part of a typed id after its first colon."""
    return F.regexp_replace(node, r"^[^:]*:", "")


def node_type(node: Column) -> Column:
    return F.substring_index(node, ":", 1)


def mask_phone(phone: Column) -> Column:
    """+9198XXXX5678; short values become all X."""
    digits = F.regexp_replace(phone, r"(?U)\D", "")
    hidden = F.repeat(F.lit("X"), F.length(phone))
    shown = F.concat(F.lit("+"), F.substring(digits, 1, 4), F.lit("XXXX"), F.right(digits, F.lit(4)))
    return F.when(F.length(digits) < 8, hidden).otherwise(shown)
