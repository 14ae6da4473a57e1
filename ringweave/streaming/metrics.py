"""Live metric streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.operators.ops_metrics import score_drift
from ringweave.session import stage
from ringweave.sources.store import first_arrivals
from ringweave.streaming.ingest import BatchTable, drain
from ringweave.streaming.state import IdLedger


class DedupeStream:
    """First arrivals of event ids; copies are dropped however late they come."""

    def __init__(self, spark: SparkSession, folder: str, bucket_rows: int | None = None) -> None:
        self.ids = IdLedger(spark, f"{folder}/ids", bucket_rows=bucket_rows)
        self.rows = BatchTable(spark, f"{folder}/rows")
        self._checkpoint = f"{folder}/checkpoint"

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        arrived = stage(batch, "arrived")
        first = stage(first_arrivals(self.ids.fresh(arrived, batch_id), "ts"), "first_arrivals")
        self.ids.put(first.select("event_id"), batch_id)
        self.rows.put(first, batch_id)

    def run(self, stream: DataFrame) -> DataFrame:
        drain(stream, self.handle, self._checkpoint)
        return self.rows.all().drop("batch")


def stream_velocity(stream: DataFrame, delay: str, folder: str, width: str = "72 hours", slide: str = "24 hours") -> DataFrame:
    """Distinct merchants per customer and sliding window.

    State is one small row per (customer, merchant, window), so a busy customer
    spreads over many rows; Spark drops a window's rows when the watermark
    passes its end. Merchants are counted when the table is read. A restart
    goes on from the folder's checkpoint.
    """
    table = BatchTable(stream.sparkSession, f"{folder}/uses")
    uses = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", width, slide).alias("w"), "customer_id", "merchant_id")
        .agg(F.count("*").alias("uses"))
        .select(F.unix_seconds("w.start").alias("window_start"), "customer_id", "merchant_id", "uses")
    )
    drain(uses, table.put, f"{folder}/checkpoint", "update")
    distinct_uses = table.all().select("window_start", "customer_id", "merchant_id").distinct()
    return distinct_uses.groupBy("window_start", "customer_id").agg(F.count("*").alias("merchants"))


def stream_band_counts(stream: DataFrame, delay: str, folder: str, width: str = "1 day") -> DataFrame:
    """Verdicts by band in tumbling windows."""
    table = BatchTable(stream.sparkSession, f"{folder}/bands")
    counts = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"), "verdict")
        .agg(F.count("*").alias("verdicts"))
        .select(F.unix_seconds("w.start").alias("window_start"), "verdict", "verdicts")
    )
    drain(counts, table.put, f"{folder}/checkpoint", "update")
    return table.latest("window_start", "verdict").drop("batch")


class DriftStream:
    """Drift of the latest scores against the first ones.

    A batch adds at most its first and last window of scores to the state
    table; the state never holds more than both windows.
    """

    def __init__(self, spark: SparkSession, folder: str, recent: int = C.RECENT_WINDOW, baseline: int = C.BASELINE_WINDOW) -> None:
        self.state = BatchTable(spark, f"{folder}/drift")
        self._recent, self._baseline, self._checkpoint = recent, baseline, f"{folder}/checkpoint"

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("ts", "event_id", "score", F.lit(batch_id).alias("arrival"))
        order = ["arrival", "ts", "event_id"]
        first = rows.orderBy(*order).limit(self._baseline).withColumn("part", F.lit("first"))
        last = rows.orderBy(*[F.desc(c) for c in order]).limit(self._recent).withColumn("part", F.lit("last"))
        merged = first.unionByName(last)
        before = self.state.all()
        if before is not None:
            held = before.where(F.col("batch") == batch_id - 1).drop("batch")
            merged = merged.unionByName(held)
        merged = stage(merged, "drift")
        keep_first = merged.where("part = 'first'").orderBy(*order).limit(self._baseline)
        keep_last = merged.where("part = 'last'").orderBy(*[F.desc(c) for c in order]).limit(self._recent)
        self.state.put(keep_first.unionByName(keep_last), batch_id)

    def run(self, stream: DataFrame) -> DataFrame:
        drain(stream, self.handle, self._checkpoint)
        table = self.state.all()
        newest = table.agg(F.max("batch")).first()[0]
        held = table.where(F.col("batch") == newest)
        # the two windows may overlap: they are told apart by their part
        order = ["arrival", "ts", "event_id"]
        base = held.where("part = 'first'").select(*order, "score")
        recent = held.where("part = 'last'").select(*order, "score")
        return score_drift(base.unionByName(recent).distinct(), order, self._recent, self._baseline)
