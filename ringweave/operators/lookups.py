"""Reads of the current graph: nodes, neighbours, clusters, entity risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave import config as C
from ringweave.functions.normalize import mask_phone, node_type, node_value
from ringweave.functions.scoring import half_even
from ringweave.operators.cluster import _rank



def customer_node(customer: Column) -> Column:
    return F.concat(F.lit("customer:"), customer)


def build_nodes(
    customers: DataFrame, entities: DataFrame, taint: DataFrame, counts: DataFrame
) -> DataFrame:
    """Node table. ``counts`` (node, merchant_count, linked_identity_count) holds
    the entity counts: last snapshot or current."""
    people = customers.select(
        customer_node(F.col("customer_id")).alias("node"),
        F.lit("customer").alias("ntype"),
        "first_seen_us",
        "last_seen_us",
        "event_count",
        F.col("fraud_ord").isNotNull().alias("confirmed_fraud"),
        F.coalesce("fraud_us", F.lit(0)).alias("fraud_us"),
        "amount_sum",
        F.col("event_count").alias("amount_count"),
    )
    things = entities.select(
        "node",
        "ntype",
        "first_seen_us",
        "last_seen_us",
        F.lit(0).cast("long").alias("event_count"),
        F.lit(False).alias("confirmed_fraud"),
        F.lit(0).cast("long").alias("fraud_us"),
        F.lit(0).cast("long").alias("amount_sum"),
        F.lit(0).cast("long").alias("amount_count"),
    )
    return (
        people.unionByName(things)
        .join(counts.select("node", "merchant_count", "linked_identity_count"), "node", "left")
        .join(taint, "node", "left")
        .fillna(0, ["merchant_count", "linked_identity_count"])
        .fillna(0.0, ["fraud_taint"])
    )


def last_snapshots(history: DataFrame) -> DataFrame:
    """Counts as stored at the last touch (both only grow)."""
    return history.groupBy("ntype", "node").agg(
        F.max("merchant_count").alias("merchant_count"), F.max("linked_identity_count").alias("linked_identity_count")
    )


def undirected_edges(links: DataFrame) -> DataFrame:
    """Both directions of every link: (node, neighbour)."""
    forward = links.select(customer_node(F.col("customer_id")).alias("node"), F.col("node").alias("neighbour"))
    return forward.unionByName(forward.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour")))


def neighbors(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Neighbours of the wanted nodes, either direction."""
    return undirected_edges(links).join(wanted.select("node").distinct(), "node", "left_semi")


def successors(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """Out-neighbours: only customers have any."""
    forward = links.select(customer_node(F.col("customer_id")).alias("node"), F.col("node").alias("successor"))
    return forward.join(wanted.select("node").distinct(), "node", "left_semi")


def edge_lookup(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Attributes of wanted (customer_id, node) links; null when absent."""
    return pairs.join(
        links.select("customer_id", "node", "first_seen_us", "last_seen_us", "event_count"), ["customer_id", "node"], "left"
    )


def node_lookup(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(nodes, "node", "left").withColumn("found", F.col("ntype").isNotNull())


def graph_size(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("ntype").agg(F.count("*").alias("nodes"))


# --- clusters ---------------------------------------------------------------
def flagged(rows: DataFrame, crowded: DataFrame, ord_: Column | None = None) -> DataFrame:
    """``rows`` with ``truncated``: their center's cluster holds more nodes than the cap (as of ``ord_``, else finally)."""
    grown = crowded.select("customer_id", "trunc_ord")
    at = F.lit(C.FOREVER - 1) if ord_ is None else ord_
    return rows.join(grown, "customer_id", "left").withColumn("truncated", F.coalesce(F.col("trunc_ord") <= at, F.lit(False))).drop("trunc_ord")


def final_members(members: DataFrame) -> DataFrame:
    """Cluster membership after the last event; ``flagged`` tells which are cut."""
    return members.where(F.col("out_ord") == C.FOREVER).select("customer_id", "ntype", "node")


def cluster_stats(members: DataFrame, counts: DataFrame, crowded: DataFrame) -> DataFrame:
    """Node counts, customers per device, widest entity and the cap's flag, per final cluster."""
    kind = F.col("ntype")
    fanout = F.when(kind.isin(*C.FANOUT_TYPES), F.col("merchant_count"))
    n = {t: F.count_if(kind == t) for t in C.NODE_TYPES}
    ratio = F.when(n["device"] > 0, half_even(n["customer"] / n["device"], 3)).otherwise(0.0)
    stats = (
        final_members(members)
        .join(counts.select("node", "merchant_count"), "node", "left")
        .groupBy("customer_id")
        .agg(
            n["customer"].alias("customers"),
            n["device"].alias("devices"),
            n["upi"].alias("vpas"),
            n["phone"].alias("phones"),
            n["email"].alias("emails"),
            n["merchant"].alias("merchants"),
            ratio.alias("device_identity_ratio"),
            F.coalesce(F.max(fanout), F.lit(0)).alias("max_cross_merchant_fanout"),
        )
    )
    return flagged(stats, crowded)


def cluster_members_r(links: DataFrame, radius: int, stage, cap: int = C.CLUSTER_CAP) -> DataFrame:
    """Final cluster for a radius of 1 to 4: (customer_id, node, hop, over_at).

    Hops alternate entity and customer steps; a center stops growing at the
    cap, keeping nodes by (hop, arrival in reach, id). ``over_at`` is the hop at which
    more nodes than the cap were in reach (null: never); such a center takes no
    further step. Each step offers only an entity's or customer's first ``cap + 1``
    links, which holds every kept node.
    """
    edges = links.select("customer_id", "ntype", "node", "fl_ord")
    by_customer = stage(_rank(edges, "customer_id", ["fl_ord", "node"], "_n", cap + 1).drop("_n"), "r_customer")
    by_entity = stage(
        _rank(edges.where("ntype <> 'merchant'"), "node", ["fl_ord"], "_n", cap + 1).drop("_n"), "r_entity"
    )
    first = stage(edges.groupBy("customer_id").agg(F.min("fl_ord").alias("reach")), "r_first")
    over = first.limit(0).select("customer_id", F.lit(0).alias("over_at"))
    kept = first.select("customer_id", customer_node(F.col("customer_id")).alias("node"), F.lit(0).alias("hop"), "reach", F.lit(-1).cast("long").alias("tie"))
    frontier = first.select("customer_id", F.col("customer_id").alias("at"), F.lit(-1).cast("long").alias("reach"))
    for hop in range(1, radius + 1):
        if hop % 2:
            step = by_customer.select(F.col("customer_id").alias("at"), F.col("node").alias("to"), "ntype", "fl_ord")
        else:
            step = by_entity.select(F.col("node").alias("at"), F.col("customer_id").alias("to"), F.lit("customer").alias("ntype"), "fl_ord")
        reached = (
            frontier.join(step, "at")
            .groupBy("customer_id", "to", "ntype")
            .agg(F.min(F.struct(F.greatest("reach", "fl_ord").alias("reach"), F.col("fl_ord").alias("tie"))).alias("k"))
            .select("customer_id", "to", "ntype", "k.reach", "k.tie", (F.col("to") if hop % 2 else customer_node(F.col("to"))).alias("node"))
        )
        fresh = reached.join(kept.select("customer_id", "node"), ["customer_id", "node"], "left_anti")
        room = kept.groupBy("customer_id").agg((F.lit(cap) - F.count("*")).alias("room"))
        w = Window.partitionBy("customer_id").orderBy("reach", "tie", "node")
        # the first node beyond the room stays in, as the sign that the cluster is cut
        near = stage(
            fresh.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap + 1).join(room, "customer_id").where("_n <= room + 1"),
            "r_hop",
        )
        added = near.where("_n <= room").drop("_n", "room")
        full = near.where("_n > room").select("customer_id", F.lit(hop).alias("over_at"))
        over = over.unionByName(full)
        kept = stage(
            kept.unionByName(added.select("customer_id", "node", F.lit(hop).alias("hop"), "reach", "tie")), "r_kept"
        )
        growing = added.where("ntype <> 'merchant'").join(full, "customer_id", "left_anti")
        frontier = growing.select("customer_id", F.col("to").alias("at"), "reach")
    return kept.select("customer_id", "node", "hop").join(over, "customer_id", "left")


def cluster_view(
    wanted: DataFrame, members: DataFrame, links: DataFrame, taint: DataFrame, crowded: DataFrame, unmask: bool = False
) -> DataFrame:
    """Drawings of the clusters of ``wanted`` (customer_id): nodes with taint, and the links of
    their customers, with the cap's flag. Phones are masked on both unless ``unmask``."""

    def shown(node: Column) -> Column:
        value = node_value(node)
        return value if unmask else F.when(node.startswith("phone:"), mask_phone(value)).otherwise(value)

    final = final_members(members).join(wanted.select("customer_id").distinct(), "customer_id", "left_semi")
    nodes = final.join(taint, "node", "left").select(
        "customer_id",
        F.lit("node").alias("part"),
        F.col("ntype").alias("kind"),
        shown(F.col("node")).alias("id"),
        F.lit(None).cast("string").alias("target"),
        F.coalesce("fraud_taint", F.lit(0.0)).alias("taint"),
    )
    targets = links.select(F.col("customer_id").alias("_c"), F.col("node").alias("_target"))
    edges = (
        final.where("ntype = 'customer'")
        .withColumn("_c", node_value(F.col("node")))
        .join(targets, "_c")
        .select(
            "customer_id",
            F.lit("edge").alias("part"),
            node_type(F.col("_target")).alias("kind"),
            F.col("_c").alias("id"),
            shown(F.col("_target")).alias("target"),
            F.lit(None).cast("double").alias("taint"),
        )
    )
    return flagged(nodes.unionByName(edges), crowded)


# --- entity risk --------------------------------------------------------------
def entity_risk(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Federated signal per (entity_type, entity_value) request."""
    signal = nodes.select(
        "node",
        "merchant_count",
        "linked_identity_count",
        "fraud_taint",
        F.floor(F.col("last_seen_us") / C.SECOND).alias("last_seen_epoch"),
        F.lit(True).alias("_known"),
    )
    known_type = F.col("entity_type").isin(*C.ENTITY_TYPES)
    return (
        requests.withColumn("node", F.concat_ws(":", "entity_type", "entity_value"))
        .join(signal, "node", "left")
        .withColumn("status", F.when(~known_type, "bad_entity_type").when(F.col("_known"), "ok").otherwise("not_found"))
        .select(
            *requests.columns,
            "status",
            *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in ("merchant_count", "linked_identity_count", "fraud_taint", "last_seen_epoch")],
        )
    )


def entity_risk_full(requests: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Privileged listing of a requested entity with all its attributes: a row a linked node.

    Unknown entities and foreign types keep a row with their status. Callers write
    ``store.admin_audit_rows`` of the requests beside it.
    """
    attributes = ["merchant_count", "linked_identity_count", "fraud_taint", "confirmed_fraud", "event_count", "amount_sum", "first_seen_us", "last_seen_us"]
    node = F.concat_ws(":", "entity_type", "entity_value")
    wanted = requests.select("entity_type", "entity_value", F.when(F.col("entity_type").isin(*C.ENTITY_TYPES), node).alias("node")).distinct()
    known = nodes.select("node", *attributes, F.lit(True).alias("_known"))
    linked = neighbors(links, wanted.where("node IS NOT NULL")).select("node", F.col("neighbour").alias("linked_node"))
    status = F.when(F.col("node").isNull(), "bad_entity_type").when(F.col("_known"), "ok").otherwise("not_found")
    return (
        wanted.join(known, "node", "left")
        .join(linked, "node", "left")
        .select("entity_type", "entity_value", status.alias("status"), "linked_node", *attributes)
    )


def entity_timeline(entities: DataFrame, asof_us: DataFrame) -> DataFrame:
    """First and last use and recency against the latest event."""
    return entities.join(F.broadcast(asof_us)).select(
        "node",
        "ntype",
        F.floor(F.col("first_seen_us") / C.SECOND).alias("first_seen"),
        F.floor(F.col("last_seen_us") / C.SECOND).alias("last_seen"),
        F.floor((F.col("asof_us") - F.col("last_seen_us")) / C.SECOND).alias("idle_seconds"),
    )
