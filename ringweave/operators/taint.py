"""Fraud taint: three min-max half-rounds over the links.

A node is tainted at hop k from the earliest moment a k-step identity path to
a confirmed-fraud customer exists: the smallest, over its links, of the later
of (neighbour tainted, link made).  Linear in the links; never walks merchants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave import config as C


def _hop(links: DataFrame, sources: DataFrame, via: str, to: str) -> DataFrame:
    """Spread one hop: sources(via, t_ord, t_vts) -> (to, t_ord, t_vts)."""
    return (
        links.join(sources, via)
        .groupBy(to)
        .agg(
            F.min(F.greatest("t_ord", "fl_ord")).alias("t_ord"),
            F.min(F.greatest("t_vts", "fl_vts")).alias("t_vts"),
        )
    )


def taint_times(links: DataFrame, customers: DataFrame) -> DataFrame:
    """(node, hop, t_ord, t_vts): when each node reaches each taint level."""
    edges = links.where(F.col("ntype") != "merchant").select("customer_id", "node", "fl_ord", "fl_vts")
    t0 = customers.where(F.col("fraud_ord").isNotNull()).select(
        "customer_id", F.col("fraud_ord").alias("t_ord"), F.col("fraud_vts").alias("t_vts")
    )
    t1 = _hop(edges, t0, "customer_id", "node")
    t2 = _hop(edges, t1, "node", "customer_id")
    t3 = _hop(edges, t2, "customer_id", "node")

    def as_node(level: DataFrame, hop: int) -> DataFrame:
        node = F.col("node") if hop % 2 else F.concat(F.lit("customer:"), F.col("customer_id"))
        return level.select(node.alias("node"), F.lit(hop).alias("hop"), "t_ord", "t_vts")

    return (
        as_node(t0, 0).unionByName(as_node(t1, 1)).unionByName(as_node(t2, 2)).unionByName(as_node(t3, 3))
    )


def taint_levels(links: DataFrame, customers: DataFrame) -> DataFrame:
    """Final taint per node: the level of its nearest source."""
    level = F.element_at(F.array(*[F.lit(v) for v in C.TAINT_BY_HOP]), F.col("hop") + 1)
    return taint_times(links, customers).groupBy("node").agg(F.max(level).alias("fraud_taint"))


def taint_paths(links: DataFrame, customers: DataFrame) -> DataFrame:
    """Per customer, its first path [customer, entity, fraud customer].

    A path is two links, so each entity offers only its two earliest fraud
    customers (two, since a customer is no path to itself); ties by id.
    """
    edges = links.where(F.col("ntype") != "merchant").select("customer_id", "node", "fl_ord")
    sources = customers.where(F.col("fraud_ord").isNotNull()).select("customer_id", "fraud_ord")
    nearest = Window.partitionBy("node").orderBy("w_ord", "fraud_customer")
    offers = (
        edges.join(sources, "customer_id")
        .select("node", F.col("customer_id").alias("fraud_customer"), F.greatest("fl_ord", "fraud_ord").alias("w_ord"))
        .withColumn("_r", F.row_number().over(nearest))
        .where("_r <= 2")
    )
    return (
        edges.join(offers, "node")
        .where("customer_id <> fraud_customer")
        .groupBy("customer_id")
        .agg(
            F.min(
                F.struct(
                    F.greatest("fl_ord", "w_ord").alias("path_ord"), "w_ord", "fraud_customer", F.col("node").alias("via")
                )
            ).alias("p")
        )
        .select("customer_id", "p.path_ord", "p.via", "p.fraud_customer")
    )
