"""Scoring rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ringweave import config as C


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value.cast("double"), digits)


def clip01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def validate_weights(weights: Mapping[str, int]) -> list[str]:
    """Violations of the weight contract; empty when valid."""
    problems = []
    if set(weights) != set(C.FEATURE_NAMES):
        problems.append("keys")
    if any(v < 0 for v in weights.values()):
        problems.append("negative")
    if sum(weights.values()) != 100:
        problems.append("sum")
    return problems


def weight_problems(weights: Column) -> Column:
    """The same contract as a column over a map of name to weight: sorted names of what is wrong."""
    names, values = F.array_sort(F.map_keys(weights)), F.map_values(weights)
    found = F.array(
        F.when(names != F.array(*[F.lit(n) for n in sorted(C.FEATURE_NAMES)]), F.lit("keys")),
        F.when(F.exists(values, lambda v: v < 0), F.lit("negative")),
        F.when(F.aggregate(values, F.lit(0).cast("long"), lambda s, v: s + v) != 100, F.lit("sum")),
    )
    return F.array_compact(found)


def checked_weights(weights: Mapping[str, int] | None) -> Mapping[str, int]:
    active = C.DEFAULT_WEIGHTS if weights is None else weights
    problems = validate_weights(active)
    if problems:
        raise ValueError(f"invalid weights: {', '.join(problems)}")
    return active


def contribution_columns(weights: Mapping[str, int] | None = None) -> list[Column]:
    """Weighted parts, looked up by feature name."""
    active = checked_weights(weights)
    return [
        half_even(F.lit(float(active[name])) * F.col(f"n_f{i}"), 4).alias(f"c_{name}")
        for i, name in enumerate(C.FEATURE_NAMES, start=1)
    ]


def score_column() -> Column:
    """0-100 score from the contribution columns, rounded half to even."""
    total = F.lit(0.0)
    for name in C.FEATURE_NAMES:
        total = total + F.col(f"c_{name}")
    bounded = half_even(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 0).cast("long")
    return F.when(total.isNotNull() & ~F.isnan(total), bounded)  # a missing part gives no score


def reason_code_column() -> Column:
    rules = (
        ("RNG_DEVICE_FANOUT", F.col("cross_merchant_fanout") >= 3),
        ("RNG_IDENTITY_FARM", (F.col("device_identity_ratio") >= 5) | (F.col("new_identity_fraction") >= 0.5)),
        ("RNG_TAINT_LINK", F.col("taint") >= 0.3),
        ("RNG_VELOCITY", F.col("velocity_merchants_72h") >= 3),
        ("RNG_BURN_ROTATE", F.col("burn_rotate") == 1),
        ("RNG_AMOUNT_PATTERN", F.col("amount_band_hit") >= 1.0),
    )
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))


def band_column(score: Column, thresholds: Mapping[str, int] | None = None) -> Column:
    cut = thresholds or C.DEFAULT_THRESHOLDS
    return F.when(score >= cut["block"], "BLOCK_REC").when(score >= cut["review"], "REVIEW").otherwise("ALLOW")
