"""Review queues over the verdict log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave import config as C


def _bounded(limit: int) -> int:
    if not C.QUEUE_LIMIT_MIN <= limit <= C.QUEUE_LIMIT_MAX:
        raise ValueError(f"limit must be {C.QUEUE_LIMIT_MIN}..{C.QUEUE_LIMIT_MAX}")
    return limit


def _top(log: DataFrame, limit: int) -> DataFrame:
    return log.orderBy(F.desc("score"), "event_id").limit(limit)


def ranked_queue(log: DataFrame, verdict: str | None = None, limit: int = C.QUEUE_LIMIT_DEFAULT) -> DataFrame:
    """Highest scores first, ties by event id."""
    return _top(log.where(F.col("verdict") == verdict) if verdict else log, _bounded(limit))


def merchant_scoped_queue(
    log: DataFrame, merchant_id: str, verdict: str | None = None, limit: int = C.QUEUE_LIMIT_DEFAULT, scope_after_limit: bool = False
) -> DataFrame:
    """A merchant's own rows; the limit applies to them unless asked otherwise."""
    mine = F.col("merchant_id") == merchant_id
    if scope_after_limit:
        return ranked_queue(log, verdict, limit).where(mine)
    return ranked_queue(log.where(mine), verdict, limit)


def pending_explanations(log: DataFrame, limit: int) -> DataFrame:
    return _top(log.where(F.col("explanation_status") == "PENDING"), limit)


def get_verdicts(log: DataFrame, wanted: DataFrame, key: str = "event_id") -> DataFrame:
    """Verdicts of the wanted ids; unknown ids come back with nulls."""
    return wanted.select(key).distinct().join(log, key, "left")


def verdict_exists(log: DataFrame, wanted: DataFrame) -> DataFrame:
    known = log.select("event_id", F.lit(True).alias("_known"))
    return wanted.join(known, "event_id", "left").withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known")
