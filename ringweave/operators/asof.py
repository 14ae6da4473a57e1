"""As-of reads of link use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave.operators.links import explode_entities
from ringweave.operators.scan import running


def first_nodes(links: DataFrame, kind: str) -> DataFrame:
    """The node of a kind each customer used first."""
    return (
        links.where(F.col("ntype") == kind)
        .groupBy("customer_id")
        .agg(F.min(F.struct("fl_ord", "node")).alias("f"))
        .select("customer_id", "f.node")
    )


def asof_edge_last_use(tl: DataFrame, probes: DataFrame, kind: str, stage: Callable, **scan) -> DataFrame:
    """Add ``last_use_us`` to probes (customer_id, node, event_id, vts, ord): the
    link's last use at or before the probe. Uses and probes of a link go through
    one scan; rows grow with uses plus probes."""
    uses = explode_entities(tl, merchants=False).where(F.col("ntype") == kind)
    rows = uses.select(
        "customer_id", "node", F.lit(None).cast("string").alias("event_id"), "vts", "ord", F.lit(0).alias("kind"), F.col("ts_us").alias("use_us")
    ).unionByName(
        probes.select("customer_id", "node", "event_id", "vts", "ord", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("use_us"))
    )
    keyed = rows.withColumn("edge", F.to_json(F.array("customer_id", "node")))
    scanned = running(stage(keyed, "edge_uses"), "edge", ["vts", "ord", "kind"], maxes={"last_use_us": F.col("use_us")}, **scan)
    return scanned.where("kind = 1").select("event_id", "customer_id", "node", "last_use_us")
