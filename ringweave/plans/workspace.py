"""Tables shared by the queries of one session and data folder."""

from __future__ import annotations

import hashlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.operators import lookups, splits, taint
from ringweave.operators.graph import LinkGraph
from ringweave.session import shared_root, stage, stage_by
from ringweave.sources import payments as P
from ringweave.sources import store

_OPEN: dict[tuple[str, str], "Workspace"] = {}


class Workspace:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return P.read_table(self.spark, self.sf_dir, name)

    def folder(self, name: str) -> str:
        return f"{shared_root(self.spark)}/{self.spark.sparkContext.applicationId}/{name}-{hashlib.sha256(self.sf_dir.encode()).hexdigest()[:12]}"

    @cached_property
    def payments(self) -> DataFrame:
        return stage(P.payments(self.spark, self.sf_dir), "payments", "zstd")

    @cached_property
    def labels(self) -> DataFrame:
        return stage(P.payment_labels(self.spark, self.sf_dir), "labels")

    @cached_property
    def graph(self) -> LinkGraph:
        return LinkGraph(self.payments)

    @cached_property
    def scored(self) -> DataFrame:
        """Features, contributions, score, band and reasons of every event: columns over the staged features."""
        return self.graph.scores()

    @cached_property
    def outcomes(self) -> DataFrame:
        return stage(
            self.scored.select("event_id", "customer_id", "merchant_id", "score", "verdict", "reason_codes", "vts", "ord").join(
                self.labels, "event_id"
            ),
            "outcomes",
            "zstd",
        )

    @cached_property
    def verdicts(self) -> DataFrame:
        return stage(self.graph.verdicts(), "verdicts")

    @cached_property
    def log(self) -> DataFrame:
        """Stored verdict table."""
        return stage(store.verdict_payload(self.verdicts), "verdict_log")

    @cached_property
    def taint(self) -> DataFrame:
        return stage(taint.taint_levels(self.graph.links, self.graph.customers), "taint_levels")

    @cached_property
    def nodes(self) -> DataFrame:
        counts = lookups.last_snapshots(self.graph.snapshots)
        return stage(lookups.build_nodes(self.graph.customers, self.graph.entities, self.taint, counts), "nodes")

    @cached_property
    def components(self) -> DataFrame:
        events = self.graph.timeline.select("event_id", "customer_id", "raw.*") if self.graph.placed else self.payments
        return splits.identity_components(splits.identity_keys(events), stage)

    @cached_property
    def _customer_labels(self) -> DataFrame:
        """Labels with customer and split, in the customer buckets of the timeline."""
        buckets = self.graph.placed
        placed = stage_by(splits.labels_by_customer(self.graph.timeline, self.labels), "customer_labels", "customer_id", buckets)
        dealt = placed.join(splits.splits_by_customer(placed, self.components, buckets, stage), "customer_id")
        rows = dealt.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        return stage_by(rows.drop("_copy", "copies", "n", "us"), "split_labels", "customer_id", buckets)

    @cached_property
    def split_labels(self) -> DataFrame:
        if self.graph.placed:  # scoring has sent the events to their customer: only labels follow
            return self._customer_labels.drop("customer_id")
        dealt = splits.assign_splits(self.payments, self.labels, self.components, stage)
        return stage(self.labels.join(dealt, "event_id"), "split_labels")

    @cached_property
    def model_rows(self) -> DataFrame:
        """Feature rows with label, split, group and fold (5 folds)."""
        rows = self.scored.select("event_id", "customer_id", "score", *[f"n_f{i}" for i in range(1, 8)])
        group = splits.ring_group(F.col("ring_id"), F.col("customer_id"))
        buckets = self.graph.placed  # scored above
        if buckets:
            rows = rows.join(self._customer_labels, ["customer_id", "event_id"]).withColumn("cv_group", group)
            return stage_by(self.with_folds(rows, 5), "model_rows", "customer_id", buckets)
        rows = stage(rows.join(self.split_labels, "event_id").withColumn("cv_group", group), "model_rows", "zstd")
        return stage(self.with_folds(rows, 5), "model_rows", "zstd")

    def with_folds(self, rows: DataFrame, folds: int) -> DataFrame:
        """Model rows with the fold of their group; of rows in customer buckets only the groups are sent."""
        dealt, buckets = splits.group_kfold(rows, folds, stage), self.graph.placed
        if not buckets:
            return rows.join(dealt, "cv_group")
        named = rows.select("customer_id", "cv_group").distinct().join(dealt, "cv_group").repartition(buckets, "customer_id")
        return rows.join(named, ["customer_id", "cv_group"])


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _OPEN:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the given times are UTC
        _OPEN[key] = Workspace(spark, str(sf_dir))
    return _OPEN[key]


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Drop the shared tables of a folder; the next query derives them anew."""
    _OPEN.pop((spark.sparkContext.applicationId, str(sf_dir)), None)
