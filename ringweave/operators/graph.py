"""The whole derivation from events to verdicts, stage by stage."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.functions import scoring as S
from ringweave.functions.normalize import node_value
from ringweave.operators import cluster, features, links, lookups, snapshots, taint
from ringweave.operators.scan import union_by
from ringweave.session import stage, stage_by


class LinkGraph:
    """Staged tables over one set of events; each is computed on first use.

    ``rank`` names an integer column: rows of rank 0 or less are history, in
    rank order, that all rows of rank 1 see whatever their times; only rank 1
    is scored.
    """

    def __init__(
        self,
        events: DataFrame,
        rank: str | None = None,
        cap: int = C.CLUSTER_CAP,
        hot_rows: int | None = None,
        slice_us: int | None = None,
        busy_events: int = C.BUSY_CUSTOMER_EVENTS,
        epoch_gain: float = C.EPOCH_GAIN,
        heavy_spans: int = C.HEAVY_CUSTOMER_SPANS,
        bucket_events: int = C.BUCKET_EVENTS,
    ) -> None:
        self._bucket_events = bucket_events
        self._heavy_spans = heavy_spans
        self._busy_events, self._epoch_gain = busy_events, epoch_gain
        self._events, self._rank, self._cap = events, rank, cap
        self._scan = {"hot_rows": hot_rows, "slice_us": slice_us}

    @cached_property
    def _sizes(self) -> tuple[int, int]:
        """(events of the customer with most, customer buckets). Without buckets
        (0), for overlays or where a customer is large or shares an event id with
        another, tables are not kept by customer and hot customers are spread."""
        if self._rank:
            return 0, 0
        counts = self._events.groupBy("customer_id").count()
        most, total = counts.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first()
        calm = most <= min(C.CALM_CUSTOMER_EVENTS, self._busy_events, self._scan["hot_rows"] or C.HOT_KEY_ROWS)
        if calm:
            who = F.coalesce("customer_id", F.lit(""))
            owners = self._events.where("event_id is not null").groupBy("event_id").agg(F.min(who).alias("a"), F.max(who).alias("b"))
            calm = owners.where("a <> b").isEmpty()
        return most, max(-(-total // self._bucket_events), min(8, 1 + total // 2_000)) if calm else 0

    @property
    def _buckets(self) -> int:
        return self._sizes[1]

    @property
    def _most_events(self) -> int | None:
        return self._sizes[0] if self._buckets else None

    def _keep(self, df: DataFrame, name: str, key: str = "customer_id") -> DataFrame:
        return stage_by(df, name, key, self._buckets) if self._buckets else stage(df, name)

    @cached_property
    def timeline(self) -> DataFrame:
        return self._keep(links.timeline(self._events, self._rank, self._buckets), "timeline")

    @property
    def placed(self) -> int:
        """Customer buckets in which the timeline already lies; 0 where it is not derived or not kept by customer."""
        return self._buckets if "timeline" in self.__dict__ else 0

    @cached_property
    def _numbered_links(self) -> DataFrame:
        """Links; in customer buckets also with their number among the customer's own (``hop1_idx``)."""
        built = links.build_links(self.timeline)
        return self._keep(cluster.numbered(built) if self._buckets else built, "links")

    @cached_property
    def links(self) -> DataFrame:
        return self._numbered_links.drop("hop1_idx")

    @cached_property
    def customers(self) -> DataFrame:
        return self._keep(links.customer_stats(self.timeline), "customers")

    @cached_property
    def entities(self) -> DataFrame:
        return stage(links.entity_stats(self.links), "entities")

    @cached_property
    def taint_times(self) -> DataFrame:
        return stage(taint.taint_times(self.links, self.customers), "taint")

    @cached_property
    def _membership(self) -> tuple[DataFrame, DataFrame]:
        wanted = self.targets.select("customer_id").distinct() if self._rank else None
        members, crowded = cluster.cluster_memberships(self._numbered_links, stage, self._cap, wanted, self._keep, self._buckets)
        return self._keep(members, "members"), stage(crowded, "crowded")

    @property
    def members(self) -> DataFrame:
        return self._membership[0]

    @property
    def crowded(self) -> DataFrame:
        return self._membership[1]

    @cached_property
    def progress(self) -> DataFrame:
        progress = snapshots.event_progress(self.timeline, self.links, stage, self._most_events, **self._scan)
        return self._keep(progress, "progress")

    @cached_property
    def _history(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        shared, alone, joint = snapshots.entity_snapshot_history(
            self.links, self.progress, stage, self._keep, self._buckets, **self._scan
        )
        return stage(shared, "snapshots", "zstd"), alone, joint

    @property
    def snapshots(self) -> DataFrame:
        shared, alone, _ = self._history
        return shared.unionByName(alone.select(*snapshots.SNAPSHOT_COLUMNS))

    @property
    def targets(self) -> DataFrame:
        """Events to score."""
        return self.timeline.where("epoch_rank = 1") if self._rank else self.timeline

    @cached_property
    def entity_reads(self) -> DataFrame:
        """Widest entity and top devices of each event's cluster, as of the event."""
        fan = self.members.where(F.col("ntype").isin(*C.FANOUT_TYPES))
        if self._buckets:
            reads = snapshots.kept_reads(
                self.targets, fan, self.links, self._history, self.customers, self._most_events, stage, self._buckets, **self._scan
            )
        else:
            reads = snapshots.cluster_reads(
                self.targets, fan, self.snapshots, stage, self._busy_events, self._epoch_gain, **self._scan
            )
        return self._keep(reads, "entity_reads")

    @cached_property
    def counters(self) -> DataFrame:
        people = features.cluster_customers(self.members)
        velocity, anchored = features.velocity(
            people, self.timeline, self.targets, stage, self._heavy_spans, self._buckets, self._keep, **self._scan
        )

        def sent(part: DataFrame) -> DataFrame:
            return part.repartition(self._buckets, "customer_id") if self._buckets else part

        handles = links.entity_stats(self.links.where("ntype = 'upi'"))
        steps = union_by(
            "customer_id",
            features.member_steps(self.members),
            sent(features.taint_steps(self.members, self.taint_times)),
            features.fresh_steps(people, self.customers, self._buckets),
            sent(velocity),
            features.amount_steps(people, self.progress, self._buckets),
            sent(features.burn_rotate_steps(self.members, people, self.customers, handles, self.timeline)),
        )
        load = features.steps_load(people, self.customers, self.members) if self._buckets else None
        counted = features.cluster_counters(self.targets, steps, stage, load, **self._scan)
        if anchored is not None:
            total = F.col("n_active_merchants") + F.coalesce("anchor_active", F.lit(0))
            counted = (
                counted.join(anchored, "event_id", "left").withColumn("n_active_merchants", total).drop("anchor_active")
            )
            return stage(counted, "counters", "zstd")
        return counted if self._buckets else stage(counted, "counters", "zstd")

    def _derive_branches(self) -> None:
        """Derive the independent tables at the same time: a cluster has room
        for more than one job, and none of them reads another's result."""
        self.links
        branches = (
            lambda: self.members,
            lambda: self._history,
            lambda: (self.customers, self.taint_times),
        )
        with ThreadPoolExecutor(len(branches)) as pool:
            for done in [pool.submit(branch) for branch in branches]:
                done.result()
        with ThreadPoolExecutor(2) as pool:
            for done in [pool.submit(lambda: self.entity_reads), pool.submit(lambda: self.counters)]:
                done.result()

    @cached_property
    def features(self) -> DataFrame:
        self._derive_branches()
        raw = features.raw_features(self.counters, self.entity_reads)
        return self._keep(lookups.flagged(features.normalize_features(raw), self.crowded, F.col("ord")), "features")

    @cached_property
    def customer_evidence(self) -> DataFrame:
        """Per customer: merchants of its cluster with their intervals (at most
        a cluster's worth), its taint path, and when its cluster outgrew the cap."""
        shop = F.struct(node_value(F.col("node")).alias("value"), "in_ord", "out_ord")
        merchants = (
            self.members.where("ntype = 'merchant'")
            .groupBy("customer_id")
            .agg(F.array_sort(F.collect_list(shop)).alias("shops"))
        )
        paths = taint.taint_paths(self.links, self.customers)
        return self._keep(
            merchants.join(paths, "customer_id", "left").join(self.crowded, "customer_id", "left"), "customer_evidence"
        )

    @property
    def evidence(self) -> DataFrame:
        """Features plus evidence: first merchants, top shared devices, taint
        path, cluster size. One join, on the customer."""
        visible = F.filter("shops", lambda m: (m["in_ord"] <= F.col("ord")) & (F.col("ord") < m["out_ord"]))
        no_devices = F.array().cast("array<struct<neg_identities:bigint,device_id:string,merchant_count:bigint>>")
        path = F.array("customer_id", node_value(F.col("via")), F.col("fraud_customer"))
        return (
            self.features.join(self.customer_evidence, "customer_id", "left")
            .withColumn("linked_merchants", F.slice(F.transform(visible, lambda m: m["value"]), 1, 8))
            .withColumn(
                "shared_devices",
                F.transform(
                    F.coalesce("top_devices", no_devices),
                    lambda d: F.struct(
                        d["device_id"].alias("device_id"),
                        (-d["neg_identities"]).alias("linked_identities"),
                        d["merchant_count"].alias("merchant_count"),
                    ),
                ),
            )
            .withColumn(
                "taint_path", F.when(F.col("path_ord") <= F.col("ord"), path).otherwise(F.array().cast("array<string>"))
            )
            .withColumn("cluster_customers", F.col("n_customer"))
            .drop("shops", "top_devices", "path_ord", "via", "fraud_customer", "trunc_ord")
        )

    def scores(self, weights: Mapping[str, int] | None = None, thresholds: Mapping[str, int] | None = None) -> DataFrame:
        """Features plus contributions, score, band and reason codes."""
        return score_frame(self.features.drop("top_devices"), weights, thresholds)

    def verdicts(
        self,
        weights: Mapping[str, int] | None = None,
        thresholds: Mapping[str, int] | None = None,
        model_version: str = C.MODEL_VERSION,
    ) -> DataFrame:
        return degraded_in_place(score_frame(self.evidence, weights, thresholds)).withColumn("model_version", F.lit(model_version))


def score_frame(
    frame: DataFrame, weights: Mapping[str, int] | None = None, thresholds: Mapping[str, int] | None = None
) -> DataFrame:
    return (
        frame.select("*", *S.contribution_columns(weights))
        .withColumn("score", S.score_column())
        .withColumn("verdict", S.band_column(F.col("score"), thresholds))
        .withColumn("reason_codes", S.reason_code_column())
    )


def degraded_in_place(scored: DataFrame) -> DataFrame:
    """Rows whose features gave no score become REVIEW with the system's code; ``degraded`` marks them."""
    lost = F.col("score").isNull() | F.isnan(F.col("score").cast("double"))
    return (
        scored.withColumn("degraded", lost)
        .withColumn("verdict", F.when(F.col("degraded"), "REVIEW").otherwise(F.col("verdict")))
        .withColumn("reason_codes", F.when(F.col("degraded"), F.array(F.lit(C.DEGRADED_CODE))).otherwise(F.col("reason_codes")))
        .withColumn("score", F.when(F.col("degraded"), F.lit(0).cast("long")).otherwise(F.col("score")))
    )


def degrade_verdict(events: DataFrame, scored: DataFrame) -> DataFrame:
    """One verdict per event; an event without features degrades to REVIEW."""
    kept = ["score", "verdict", "reason_codes"]
    joined = events.select("event_id", "customer_id", "merchant_id").join(
        scored.select("event_id", *kept, F.lit(True).alias("_ok")), "event_id", "left"
    )
    lost = F.col("_ok").isNull()
    return joined.select(
        "event_id",
        "customer_id",
        "merchant_id",
        F.when(lost, F.lit(0).cast("long")).otherwise(F.col("score")).alias("score"),
        F.when(lost, "REVIEW").otherwise(F.col("verdict")).alias("verdict"),
        F.when(lost, F.array(F.lit(C.DEGRADED_CODE))).otherwise(F.col("reason_codes")).alias("reason_codes"),
        F.when(lost, "customer not in graph").alias("degradation_note"),
        lost.alias("degraded"),
    )


def score_overlay(history: DataFrame, overlay: DataFrame, **options) -> LinkGraph:
    """Score ``overlay`` in time order on top of a full ``history``."""
    ranked = history.withColumn("epoch_rank_in", F.lit(0)).unionByName(overlay.withColumn("epoch_rank_in", F.lit(1)))
    return LinkGraph(ranked, rank="epoch_rank_in", **options)
