"""Event timeline and identity link graph (edges and nodes)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.functions.normalize import normalize_ip, typed_node_id, with_entities


def normalize_event_entities(events: DataFrame) -> DataFrame:
    """Events plus the five normalized entities; a bad phone stays for audit."""
    return with_entities(events).select(
        "*",
        normalize_ip(F.col("ip")).alias("ip_entity"),
        F.when(F.col("phone_entity").isNull(), F.col("phone")).alias("unnormalized_phone"),
    )


def graph_entities(events: DataFrame) -> DataFrame:
    """The entities that link; addresses never do."""
    return with_entities(events).select("event_id", "customer_id", *[f"{k}_entity" for k in C.ENTITY_TYPES])


def timeline(events: DataFrame, rank: str | None = None, buckets: int = 0) -> DataFrame:
    """Events in their total order, with graph-ready columns.

    ``ord`` grows along (rank, time, event id): a range sort gives every
    partition an increasing id block, so no global window is needed.  ``vts`` is
    the time an event becomes visible; with a rank, history (rank <= 0) is older
    than everything scored (rank 1). Stage the result: ``ord`` must not be computed twice.
    With ``buckets`` the rows go to their customer bucket raw, which is shorter than with node ids,
    and ``raw`` keeps the identities as they came.
    """
    epoch_rank = F.col(rank).cast("int") if rank else F.lit(1)
    placed = (
        events.select(
            "event_id",
            "customer_id",
            "merchant_id",
            F.col("amount_paise").cast("long").alias("amount_paise"),
            F.unix_micros("ts").alias("ts_us"),
            epoch_rank.alias("epoch_rank"),
            "upi_vpa",
            "phone",
            "device_id",
            "email",
            "prior_outcome",
        )
        .orderBy("epoch_rank", "ts_us", "event_id")
        .withColumn("ord", F.monotonically_increasing_id())
    )
    raw = []
    if buckets:
        placed = placed.repartition(buckets, "customer_id")
        raw = [F.struct("upi_vpa", "phone", "device_id", "email").alias("raw")]
    return with_entities(placed).select(
        "event_id",
        "customer_id",
        "merchant_id",
        "amount_paise",
        "ts_us",
        "epoch_rank",
        F.when(F.col("epoch_rank") <= 0, F.lit(C.BEFORE_ALL)).otherwise(F.col("ts_us")).alias("vts"),
        F.coalesce(F.col("prior_outcome").isin(*C.FRAUD_OUTCOMES), F.lit(False)).alias("fraud_outcome"),
        *[F.when(F.col(f"{k}_entity").isNotNull(), typed_node_id(k, F.col(f"{k}_entity"))).alias(k) for k in C.ENTITY_TYPES],
        typed_node_id("merchant", F.col("merchant_id")).alias("merchant"),
        "ord",
        *raw,
    )


def explode_entities(tl: DataFrame, merchants: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (event, linked node), with ``extra`` event columns."""
    kinds = [*C.ENTITY_TYPES, *(["merchant"] if merchants else [])]
    nodes = F.filter(
        F.array(*[F.struct(F.lit(k).alias("ntype"), F.col(k).alias("node")) for k in kinds]),
        lambda n: n["node"].isNotNull(),
    )
    return tl.select(
        "event_id", "customer_id", "ts_us", "vts", "ord", *extra, F.inline(nodes).alias("ntype", "node")
    )


def build_links(tl: DataFrame) -> DataFrame:
    """One row per (customer, node): first position, times and use count."""
    return (
        explode_entities(tl)
        .groupBy("customer_id", "ntype", "node")
        .agg(
            F.min("ord").alias("fl_ord"),
            F.min("vts").alias("fl_vts"),
            F.min_by("ts_us", "ord").alias("first_seen_us"),
            F.max("ts_us").alias("last_seen_us"),
            F.count(F.lit(1)).alias("event_count"),
        )
    )


def customer_stats(tl: DataFrame) -> DataFrame:
    """Customer nodes with amounts and their confirmed-fraud state."""
    fraud, history = F.col("fraud_outcome"), F.col("epoch_rank") <= 0
    return tl.groupBy("customer_id").agg(
        F.min("ord").alias("first_ord"),
        F.min("vts").alias("first_vts"),
        F.min_by("ts_us", "ord").alias("first_seen_us"),
        F.max("ts_us").alias("last_seen_us"),
        F.count(F.lit(1)).alias("event_count"),
        F.sum("amount_paise").alias("amount_sum"),
        F.min(F.when(fraud, F.col("ord"))).alias("fraud_ord"),
        F.min(F.when(fraud, F.col("vts"))).alias("fraud_vts"),
        F.min(F.when(fraud, F.col("ts_us"))).alias("fraud_us"),
        # the same, split into history and scored events
        F.min(F.when(fraud & history, F.col("ord"))).alias("old_fraud_ord"),
        F.min(F.when(fraud & history, F.col("ts_us"))).alias("old_fraud_us"),
        F.min(F.when(fraud & ~history, F.col("ord"))).alias("new_fraud_ord"),
        F.min(F.when(fraud & ~history, F.col("ts_us"))).alias("new_fraud_us"),
    )


def fraud_times(customers: DataFrame) -> DataFrame:
    """(customer_id, fraud_us, from/to position): the earliest fraud time known
    at each moment. History counts as one step; scored events come in time
    order, so only their first fraud can still lower it."""
    old, new = F.col("old_fraud_us"), F.col("new_fraud_us")
    lowers = F.coalesce(new < old, new.isNotNull())
    first = F.struct(
        old.alias("fraud_us"),
        F.lit(C.BEFORE_ALL).alias("from_vts"),
        F.col("old_fraud_ord").alias("from_ord"),
        F.when(lowers, new).otherwise(F.lit(C.FOREVER)).alias("to_vts"),
        F.when(lowers, F.col("new_fraud_ord")).otherwise(F.lit(C.FOREVER)).alias("to_ord"),
    )
    second = F.struct(
        new.alias("fraud_us"),
        new.alias("from_vts"),
        F.col("new_fraud_ord").alias("from_ord"),
        F.lit(C.FOREVER).alias("to_vts"),
        F.lit(C.FOREVER).alias("to_ord"),
    )
    versions = F.array_compact(F.array(F.when(old.isNotNull(), first), F.when(lowers, second)))
    return (
        customers.where("fraud_us is not null")
        .select("customer_id", F.inline(versions).alias("fraud_us", "from_vts", "from_ord", "to_vts", "to_ord"))
        .where("fraud_us > 0")
    )


def entity_stats(links: DataFrame) -> DataFrame:
    """Entity and merchant nodes: times and number of linked customers."""
    return links.groupBy("ntype", "node").agg(
        F.min("fl_ord").alias("first_ord"),
        F.min("fl_vts").alias("first_vts"),
        F.min_by("first_seen_us", "fl_ord").alias("first_seen_us"),
        F.max("last_seen_us").alias("last_seen_us"),
        F.count(F.lit(1)).alias("n_customers"),
    )
