"""Operational metric tables: counters, latency, drift, narratives, model cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.functions.scoring import half_even
from ringweave.operators.reports import value_at_rank



def verdict_band_counters(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy(F.lower("verdict").alias("band")).agg(
        F.count("*").alias("verdicts"), F.count_if(F.col("degraded")).alias("degraded")
    )


def latency_histogram(samples: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Cumulative buckets, total count and sum, one row per bound."""
    x = F.col(seconds)
    bounds = [*[(str(b), b) for b in C.LATENCY_BUCKETS], ("+Inf", None)]
    row = samples.agg(
        *[(F.count_if(x <= b) if b is not None else F.count(x)).alias(f"b{i}") for i, (_, b) in enumerate(bounds)],
        F.count(x).alias("n"),
        half_even(F.sum(x), 6).alias("s"),
    )
    pairs = F.array(*[F.struct(F.lit(name).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, (name, _) in enumerate(bounds)])
    return row.select(F.inline(pairs).alias("le", "bucket_count"), "n", "s").select(
        "le", "bucket_count", F.col("n").alias("total_count"), F.col("s").alias("total_sum")
    )


def score_drift(scores: DataFrame, order: list[str], recent: int = C.RECENT_WINDOW, baseline: int = C.BASELINE_WINDOW) -> DataFrame:
    """Mean of the latest scores against the mean of the first ones.

    Both windows are small by definition (top-k by order); drift is 0 until the
    baseline window is full.
    """
    first = scores.orderBy(*order).limit(baseline).agg(F.avg("score").alias("base_mean"), F.count("*").alias("base_n"))
    last = scores.orderBy(*[F.desc(c) for c in order]).limit(recent).agg(F.avg("score").alias("recent_mean"))
    return first.join(F.broadcast(last)).select(
        half_even(F.col("recent_mean"), 4).alias("score_mean_recent"),
        half_even(F.when(F.col("base_n") >= baseline, F.col("recent_mean") - F.col("base_mean")).otherwise(0.0), 4).alias("score_drift"),
    )


def steady_samples(samples: DataFrame, order: list[str], warmup: int = C.LATENCY_WARMUP) -> DataFrame:
    """Samples after the warm-up; all of them when there are no more."""
    lead = samples.orderBy(*order).limit(warmup + 1).select(F.struct(*order).alias("o"))
    cut = lead.agg(F.count("*").alias("n"), F.max("o").alias("o"))
    return (
        samples.join(F.broadcast(cut))
        .where((F.col("n") <= warmup) | (F.struct(*order) >= F.col("o")))
        .drop("n", "o")
    )


def _exact_rank(counts: DataFrame, value: str, rank, name: str) -> DataFrame:
    return value_at_rank(counts, value, rank).withColumnRenamed(value, name)


def latency_summary(samples: DataFrame, micros: str, order: list[str], wall_seconds: Column, stage, digits: int = 2) -> DataFrame:
    """Throughput and nearest-rank percentiles (ms) of the steady samples.

    ``micros`` is a whole number of microseconds; percentiles are read off
    value counts, so no task sorts all samples.
    """
    total = samples.agg(F.count("*").alias("events"), wall_seconds.alias("wall"))
    counts = stage(steady_samples(samples, order).groupBy(micros).agg(F.count("*").alias("n")), "latency_counts")
    out = total.select("events", half_even(F.col("events") / F.col("wall"), 1).alias("throughput_events_per_sec"))
    for name, q in (("p50", 0.50), ("p95", 0.95), ("p99", 0.99)):
        nearest = lambda n, q=q: F.greatest(F.ceil(n * F.lit(q)) - 1, F.lit(0))
        out = out.join(F.broadcast(_exact_rank(counts, micros, nearest, name)))
    out = out.join(F.broadcast(counts.agg(F.max(micros).alias("max"))))
    return out.select(
        "events", "throughput_events_per_sec", *[half_even(F.col(c) / 1000, digits).alias(f"{c}_ms") for c in ("p50", "p95", "p99", "max")]
    )


def latency_eval_percentiles(samples: DataFrame, micros: str, stage) -> DataFrame:
    """Median and the index rule sorted[int(.95 n)], in milliseconds."""
    counts = stage(samples.groupBy(micros).agg(F.count("*").alias("n")), "latency_counts")
    lower = _exact_rank(counts, micros, lambda n: F.floor((n - 1) / 2), "lo")
    upper = _exact_rank(counts, micros, lambda n: F.floor(n / 2), "hi")
    p95 = _exact_rank(counts, micros, lambda n: F.floor(n * F.lit(0.95)), "p95")
    return (
        counts.agg(F.sum("n").alias("events"))
        .join(F.broadcast(lower))
        .join(F.broadcast(upper))
        .join(F.broadcast(p95))
        .select("events", half_even((F.col("lo") + F.col("hi")) / 2000, 3).alias("p50_ms"), half_even(F.col("p95") / 1000, 3).alias("p95_ms"))
    )


def narrative_status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("explanation_status").agg(F.count("*").alias("verdicts"))


def skipped_share(log: DataFrame) -> DataFrame:
    """Share of flagged verdicts whose narrative was skipped."""
    flagged = log.where(F.col("verdict") != "ALLOW")
    skipped = F.count_if(F.col("explanation_status") == "SKIPPED")
    return flagged.agg(
        F.count("*").alias("flagged"), skipped.alias("skipped"), half_even(skipped / F.count("*"), 4).alias("skipped_share")
    )


def llm_cost_estimate(calls: DataFrame) -> DataFrame:
    """Calls with an estimated cost; unknown models use the default price."""
    prices = calls.sparkSession.createDataFrame(
        [(m, i, o) for m, (i, o) in C.PRICE_PER_MTOKEN.items()], "model_id string, price_in double, price_out double"
    )
    per_token = lambda tokens, price, default: F.col(tokens) / 1_000_000 * F.coalesce(price, F.lit(default))
    return (
        calls.join(F.broadcast(prices), "model_id", "left")
        .withColumn(
            "cost_estimate_usd",
            half_even(
                per_token("input_tokens", "price_in", C.DEFAULT_PRICE[0]) + per_token("output_tokens", "price_out", C.DEFAULT_PRICE[1]), 6
            ),
        )
        .drop("price_in", "price_out")
    )


def llm_cost_rollup(costed: DataFrame, *keys: str) -> DataFrame:
    return costed.groupBy(*keys).agg(
        F.count("*").alias("calls"), half_even(F.sum("cost_estimate_usd"), 4).alias("total_estimate_usd")
    )
