"""Payment events derived from the given order tables.

One payment per order, at the merchant of its first supplier (merchant 0 without
line items); a deterministic rule gives every order its identities, so that rings, shared households, bad phones and missing
values all occur. ``payments`` carries no label; ``payment_labels`` only labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the fixture
EPOCH_START = 1_780_272_000
DAY_ZERO = 788_918_400
DAY_STRETCH = 3060


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(prefix: str, value: Column, width: int) -> Column:
    """Prefix and number, zero-filled to ``width``; longer numbers stay whole."""
    digits = value.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), "0"))


def _floor_to(value: Column, n: int) -> Column:
    return ((value - value % n) / n).cast("bigint")


def _order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"))
    orders = read_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    block = _floor_to(c, 10)
    return orders.join(suppliers, orders.o_orderkey == suppliers.l_orderkey, "left").select(
        k.alias("k"),
        c.alias("c"),
        F.coalesce("s", F.lit(0)).alias("s"),
        F.col("o_totalprice").alias("price"),
        block.alias("blk"),
        (c % 10).alias("pos"),
        ((c % 10 < 6) & (block % 10 == 0)).alias("ring"),
        ((F.unix_timestamp("o_orderdate") - DAY_ZERO) / 86400).cast("bigint").alias("d"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, s, blk, pos, ring = (F.col(n) for n in ("k", "c", "s", "blk", "pos", "ring"))

    def text(*parts) -> Column:
        return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    # ordinary phones have room for 3.1 G customers below the ring phones
    ring_phone = F.lit(9_100_000_000) + blk * 10 + pos % 2
    prefix = F.when(k % 3 == 0, "0").when(k % 3 == 1, "+91 ").otherwise("")
    epoch = F.lit(EPOCH_START) + F.col("d") * DAY_STRETCH + (k * 37) % DAY_STRETCH
    return _order_keys(spark, sf_dir).select(
        padded("evt_", k, 9).alias("event_id"),
        padded("mcht_", s, 5).alias("merchant_id"),
        padded("cust_", c, 7).alias("customer_id"),
        F.floor("price").cast("bigint").alias("amount_paise"),
        F.lit("INR").alias("currency"),
        F.when(k % 20 < 17, F.when(ring, text(" Ring", blk, ".", k % 4, "@YBL")).otherwise(text("user", c, "@okaxis "))).alias(
            "upi_vpa"
        ),
        F.when(k % 41 == 0, "12345")
        .when(ring, F.concat(prefix, ring_phone.cast("string")))
        .otherwise(text("+91-", F.lit(6_000_000_000) + c))
        .alias("phone"),
        F.when(ring, text("DEV_R", blk, "_", k % 2))
        .when((c % 7 == 0) & (k % 4 == 0), text("dev_h", _floor_to(c, 14)))
        .when(k % 53 == 0, F.lit(None).cast("string"))
        .otherwise(text("dev_", c))
        .alias("device_id"),
        F.when(k % 9 == 0, F.lit(None).cast("string"))
        .when(k % 97 == 0, "not-an-email")
        .otherwise(text("C", c, "@Example.com"))
        .alias("email"),
        F.when(k % 101 == 0, "103.1.1.999").otherwise(text("103.", 10 + k % 90, ".", 1 + c % 254, ".7")).alias("ip"),
        F.timestamp_seconds(epoch).alias("ts"),
        F.when(k % 20 < 17, "upi").when(k % 20 < 19, "card").otherwise("netbanking").alias("payment_method"),
        F.when(ring & (k % 10 < 2), "chargeback")
        .when(ring & (k % 10 == 2), "refund_abuse")
        .when(k % 400 == 0, "chargeback")
        .alias("prior_outcome"),
    )


def payment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth, kept apart from the serving rows (no split yet)."""
    ring, blk = F.col("ring"), F.col("blk")
    return _order_keys(spark, sf_dir).select(
        padded("evt_", F.col("k"), 9).alias("event_id"),
        ring.alias("is_fraud"),
        F.when(ring, padded("ring_", blk, 6)).alias("ring_id"),
        F.when(ring, F.when(blk % 20 == 0, "sophisticated").otherwise("standard")).alias("ring_strategy"),
    )
