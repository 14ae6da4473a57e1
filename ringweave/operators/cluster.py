"""Local clusters over time: who is in each customer's cluster, and when.

A cluster reaches three hops and treats merchants as leaves, so it is: the
customer, its own nodes (hop 1), customers sharing an entity (hop 2) and their
nodes (hop 3).  At most ``CLUSTER_CAP`` nodes are kept, ordered by (hop, moment
the node came within reach, id).  Membership is given as intervals
``[in, out)`` along the timeline, so one table answers for every event.

All candidate lists are bounded by the cap without losing a kept node: the
n-th kept node of a merged list is among the first n of every list merged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave import config as C
from ringweave.operators.scan import union_by

MEMBER_COLUMNS = ("customer_id", "ntype", "node", "in_vts", "in_ord", "out_vts", "out_ord")


def _rank(df: DataFrame, key: str, order: list[str], name: str, limit: int) -> DataFrame:
    """First ``limit`` rows per key (pre-limited before the shuffle)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= limit)


def numbered(links: DataFrame) -> DataFrame:
    """Links with their number in the customer's order of arrival; customers have to be small."""
    return links.withColumn("hop1_idx", F.row_number().over(Window.partitionBy("customer_id").orderBy("fl_ord", "node")))


def own_nodes(links: DataFrame, cap: int = C.CLUSTER_CAP) -> DataFrame:
    """Hop 1: a customer's own nodes in arrival order, the first ``cap``."""
    columns = ("customer_id", "ntype", "node", "fl_ord", "fl_vts")
    if "hop1_idx" in links.columns:
        return links.where(F.col("hop1_idx") <= cap).select(*columns, "hop1_idx")
    picked = links.select(*columns)
    return _rank(picked, "customer_id", ["fl_ord", "node"], "hop1_idx", cap)


def neighbour_customers(links: DataFrame, centers: DataFrame, cap: int = C.CLUSTER_CAP) -> DataFrame:
    """Hop 2: customers sharing an entity, with the moment they came in reach.

    ``centers`` are the own nodes of the customers asked for.
    """
    entity_links = links.where(F.col("ntype") != "merchant").select("customer_id", "node", "fl_ord", "fl_vts")
    first_users = _rank(entity_links, "node", ["fl_ord"], "_p", cap + 1).select(
        "node",
        F.col("customer_id").alias("other_id"),
        F.col("fl_ord").alias("o_ord"),
        F.col("fl_vts").alias("o_vts"),
    )
    mine = centers.where((F.col("ntype") != "merchant") & (F.col("hop1_idx") < cap))
    pairs = (
        mine.join(first_users, "node")
        .where("customer_id <> other_id")
        .groupBy("customer_id", "other_id")
        .agg(
            F.min(
                F.struct(
                    F.greatest("fl_ord", "o_ord").alias("join_ord"),
                    "o_ord",
                    F.greatest("fl_vts", "o_vts").alias("join_vts"),
                )
            ).alias("k")
        )
        .select("customer_id", "other_id", "k.join_ord", "k.o_ord", "k.join_vts")
    )
    return _rank(pairs, "customer_id", ["join_ord", "o_ord"], "hop2_idx", cap)


def reachable_nodes(
    own: DataFrame, centers: DataFrame, pairs: DataFrame, cap: int = C.CLUSTER_CAP, buckets: int = 0
) -> DataFrame:
    """Hop 1 and hop 3 nodes per customer: own arrival and arrival via others.

    Once hops 0-2 alone exceed the cap nothing at hop 3 can be kept or change
    the truncation flag, so later hop-3 arrivals are not produced.
    """
    sizes = (
        centers.groupBy("customer_id")
        .agg(F.max("hop1_idx").alias("n1"))
        .join(pairs.groupBy("customer_id").agg(F.max("hop2_idx").alias("n2")), "customer_id")
        .where(F.col("n1") + F.col("n2") >= cap)
        .select("customer_id")
    )
    arrivals = centers.select("customer_id", F.col("fl_ord").alias("a_ord")).unionByName(
        pairs.select("customer_id", F.col("join_ord").alias("a_ord"))
    )
    full = (
        _rank(arrivals.join(sizes, "customer_id", "left_semi"), "customer_id", ["a_ord"], "_n", cap)
        .where(F.col("_n") == cap)
        .select("customer_id", F.col("a_ord").alias("full_ord"))
    )
    theirs = own.select(
        F.col("customer_id").alias("other_id"), "ntype", "node", F.col("fl_ord").alias("n_ord"), F.col("fl_vts").alias("n_vts")
    )
    via = (
        pairs.where(F.col("hop2_idx") < cap)
        .join(full, "customer_id", "left")
        .join(theirs, "other_id")
        .select(
            "customer_id",
            "ntype",
            "node",
            F.greatest("join_ord", "n_ord").alias("via_ord"),
            F.greatest("join_vts", "n_vts").alias("via_vts"),
            F.col("n_ord").alias("via_key"),
            "full_ord",
        )
        .where(F.col("full_ord").isNull() | (F.col("via_ord") < F.col("full_ord")))
    )
    if buckets:
        via = via.repartition(buckets, "customer_id")
    via = (
        via.groupBy("customer_id", "ntype", "node")
        .agg(F.min(F.struct("via_ord", "via_key", "via_vts")).alias("v"))
        .select("customer_id", "ntype", "node", "v.via_ord", "v.via_key", "v.via_vts")
    )

    def nothing(*names: str) -> list[Column]:
        return [F.lit(None).cast("int" if n == "hop1_idx" else "long").alias(n) for n in names]

    both = union_by(  # a node is at most once in each
        "customer_id",
        centers.select("customer_id", "ntype", "node", "hop1_idx", "fl_ord", "fl_vts", *nothing("via_ord", "via_key", "via_vts")),
        via.select("customer_id", "ntype", "node", *nothing("hop1_idx", "fl_ord", "fl_vts"), "via_ord", "via_key", "via_vts"),
    )
    return both.groupBy("customer_id", "ntype", "node").agg(
        *[F.max(c).alias(c) for c in ("hop1_idx", "fl_ord", "fl_vts", "via_ord", "via_key", "via_vts")]
    )


def cluster_memberships(
    links: DataFrame, stage, cap: int = C.CLUSTER_CAP, wanted: DataFrame | None = None, keep: Callable | None = None, buckets: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(memberships, crowded): intervals, and centers that outgrow the cap.

    ``wanted`` (customer_id) limits the centers; all customers otherwise.
    ``keep`` stages tables by customer, where ``links`` lie in ``buckets`` customer buckets
    (staged and ``numbered``).

    ``crowded`` has (customer_id, trunc_ord): the first event whose cluster
    holds more than ``cap`` nodes.
    """
    keep = keep or stage
    own = own_nodes(links, cap)
    if "hop1_idx" not in links.columns:
        own = keep(own, "own_nodes")
    centers = own if wanted is None else stage(own.join(wanted, "customer_id", "left_semi"), "centers")
    pairs = keep(neighbour_customers(links, centers, cap), "pairs")
    nodes = keep(reachable_nodes(own, centers, pairs, cap, buckets), "reach")

    n_nodes = nodes.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    n_pairs = pairs.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n2"))
    crowd = stage(
        n_nodes.join(n_pairs, "customer_id", "left")
        .where(1 + F.col("n") + F.coalesce("n2", F.lit(0)) > cap)
        .select("customer_id"),
        "crowd",
    )
    forever = [F.lit(C.FOREVER).alias("out_vts"), F.lit(C.FOREVER).alias("out_ord")]
    selves = centers.groupBy("customer_id").agg(F.min("fl_vts").alias("in_vts"), F.min("fl_ord").alias("in_ord")).select(
        "customer_id",
        F.lit("customer").alias("ntype"),
        F.concat(F.lit("customer:"), "customer_id").alias("node"),
        "in_vts",
        "in_ord",
        *forever,
    )
    others = pairs.select(
        "customer_id",
        F.lit("customer").alias("ntype"),
        F.concat(F.lit("customer:"), "other_id").alias("node"),
        F.col("join_vts").alias("in_vts"),
        F.col("join_ord").alias("in_ord"),
        *forever,
    )
    reached = nodes.select(
        "customer_id",
        "ntype",
        "node",
        F.least("fl_vts", "via_vts").alias("in_vts"),
        F.least("fl_ord", "via_ord").alias("in_ord"),
        *forever,
    )
    everyone = union_by("customer_id", others, reached)
    if crowd.isEmpty():
        return union_by("customer_id", selves, everyone), crowd.withColumn("trunc_ord", F.lit(C.FOREVER))

    calm = everyone.join(crowd, "customer_id", "left_anti")
    tight = _crowded(centers, pairs, nodes, crowd, cap)
    arrivals = everyone.join(crowd, "customer_id", "left_semi")
    crowded = (
        _rank(arrivals, "customer_id", ["in_ord", "node"], "_n", cap)
        .where(F.col("_n") == cap)
        .select("customer_id", F.col("in_ord").alias("trunc_ord"))
    )
    return selves.unionByName(calm).unionByName(tight), crowded


def _crowded(own: DataFrame, pairs: DataFrame, nodes: DataFrame, crowd: DataFrame, cap: int) -> DataFrame:
    """Kept intervals of the centers that outgrow the cap.

    Ranks only grow with time, so each node has one moment it drops out: when
    enough nodes ahead of it have arrived.  A hop-3 node may come back for good
    when the customer uses it directly.
    """
    own = own.join(crowd, "customer_id", "left_semi")
    pairs = pairs.join(crowd, "customer_id", "left_semi")
    nodes = nodes.join(crowd, "customer_id", "left_semi")
    via = _rank(
        nodes.where(F.col("via_ord").isNotNull()), "customer_id", ["via_ord", "via_key", "node"], "hop3_idx", cap
    )
    hop1 = own.join(via.select("customer_id", "node", "hop3_idx"), ["customer_id", "node"], "left")
    ahead = (
        hop1.select(
            "customer_id",
            F.struct(
                F.col("fl_ord").alias("ord"),
                F.col("fl_vts").alias("vts"),
                F.coalesce("hop3_idx", F.lit(cap + 1)).alias("idx"),
            ).alias("a"),
        )
        .unionByName(
            pairs.select(
                "customer_id",
                F.struct(
                    F.col("join_ord").alias("ord"), F.col("join_vts").alias("vts"), F.lit(cap + 1).alias("idx")
                ).alias("a"),
            )
        )
        .groupBy("customer_id")
        .agg(F.array_sort(F.collect_list("a")).alias("ahead"))  # at most 2*cap entries
    )
    never = F.struct(F.lit(C.FOREVER).alias("ord"), F.lit(C.FOREVER).alias("vts"))

    def drop_out(later):
        return F.coalesce(later, never)

    hop1_kept = own.where(F.col("hop1_idx") < cap).select(
        "customer_id",
        "ntype",
        "node",
        F.col("fl_vts").alias("in_vts"),
        F.col("fl_ord").alias("in_ord"),
        never["vts"].alias("out_vts"),
        never["ord"].alias("out_ord"),
    )
    limits = own.select(
        "customer_id",
        (F.lit(cap) - F.col("hop1_idx")).alias("hop2_idx"),
        F.struct(F.col("fl_ord").alias("ord"), F.col("fl_vts").alias("vts")).alias("later"),
    )
    hop2_kept = (
        pairs.where(F.col("hop2_idx") < cap)
        .join(limits, ["customer_id", "hop2_idx"], "left")
        .withColumn("out", drop_out(F.col("later")))
        .select(
            "customer_id",
            F.lit("customer").alias("ntype"),
            F.concat(F.lit("customer:"), "other_id").alias("node"),
            F.col("join_vts").alias("in_vts"),
            F.col("join_ord").alias("in_ord"),
            F.col("out.vts").alias("out_vts"),
            F.col("out.ord").alias("out_ord"),
        )
    )
    later = F.try_element_at(
        F.filter("ahead", lambda a: a["idx"] > F.col("hop3_idx")), (F.lit(cap) - F.col("hop3_idx")).cast("int")
    )
    used = F.when(F.col("fl_ord").isNotNull(), F.struct(F.col("fl_ord").alias("ord"), F.col("fl_vts").alias("vts")))
    hop3_kept = (
        via.where(F.col("hop3_idx") < cap)
        .join(ahead, "customer_id")
        .withColumn("gone", F.struct(later["ord"].alias("ord"), later["vts"].alias("vts")))
        .withColumn("out", F.least(drop_out(F.when(later.isNotNull(), F.col("gone"))), drop_out(used)))
        .select(
            "customer_id",
            "ntype",
            "node",
            F.col("via_vts").alias("in_vts"),
            F.col("via_ord").alias("in_ord"),
            F.col("out.vts").alias("out_vts"),
            F.col("out.ord").alias("out_ord"),
        )
    )
    return hop1_kept.unionByName(hop2_kept).unionByName(hop3_kept).where(F.col("in_ord") < F.col("out_ord"))
