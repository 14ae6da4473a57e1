"""Running aggregates along a key's timeline, safe for hot keys.

A plain window puts a whole key in one task.  Keys with more than ``hot_rows``
rows are cut into time slices instead: each slice is scanned on its own and the
totals of the earlier slices are added afterwards.  Results are identical.

Rows carry a position ``(vts, ord)``: visible time, then event order.  Rows
that expire at a time rather than at an event use ``ord = FOREVER``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave import config as C


def time_slice(slice_us: int) -> Column:
    """Slice number, non-decreasing along (vts, ord).

    Rows older than everything (history seen by an overlay) are sliced by the
    sorted partition their event came from.
    """
    by_partition = F.shiftright(F.col("ord"), 33) - F.lit(2**40)
    return F.when(F.col("vts") == C.BEFORE_ALL, by_partition).otherwise(
        F.floor(F.col("vts") / F.lit(slice_us)).cast("long")
    )


def union_by(key: str, *frames: DataFrame) -> DataFrame:
    """Union by name that keeps the rows of ``key`` where they lie, if all frames have them in the same buckets.

    Spark 4.1 sees that only where the key is an alias in every frame.
    """
    aliased = [f.withColumnRenamed(key, "_union_key") for f in frames]
    return reduce(DataFrame.unionByName, aliased).withColumnRenamed("_union_key", key)


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame | None:
    """Keys above the row limit, or None. At most rows/hot_rows keys exist."""
    hot = df.groupBy(key).count().where(F.col("count") > hot_rows).select(key)
    found = hot.limit(C.MAX_BROADCAST_HOT_KEYS + 1).collect()
    if not found:
        return None
    flagged = hot.withColumn("_hot", F.lit(True))
    if len(found) > C.MAX_BROADCAST_HOT_KEYS:
        return flagged
    small = df.sparkSession.createDataFrame([(r[0], True) for r in found], f"`{key}` string, `_hot` boolean")
    return F.broadcast(small)


def running(
    df: DataFrame,
    key: str,
    order: list[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    hot_rows: int | None = None,
    slice_us: int | None = None,
    load: int | None = None,
    stage: Callable | None = None,
    name: str = "scan_in",
) -> DataFrame:
    """Append running sums and running maxima per key, current row included.

    ``df`` should be a staged table: it is read twice. With ``stage`` it is
    staged here, unless no key can have more than ``load`` rows and these are
    few: then it is read once.
    """
    sums, maxes = sums or {}, maxes or {}
    hot_rows = C.HOT_KEY_ROWS if hot_rows is None else hot_rows
    slice_us = C.SLICE_US if slice_us is None else slice_us
    aggregates = {n: (F.sum, c) for n, c in sums.items()} | {n: (F.max, c) for n, c in maxes.items()}
    calm = load is not None and load <= hot_rows
    if stage is not None and not calm:
        df = stage(df, name)
    hot = None if calm else hot_keys(df, key, hot_rows)
    if hot is None:
        w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[fn(c).over(w).alias(n) for n, (fn, c) in aggregates.items()])

    tagged = df.join(hot, key, "left").withColumn(
        "_slice", F.when(F.col("_hot"), time_slice(slice_us)).otherwise(F.lit(0).cast("long"))
    )
    w = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[fn(c).over(w).alias(n) for n, (fn, c) in aggregates.items()])
    totals = (
        tagged.where(F.col("_hot")).groupBy(key, "_slice").agg(*[fn(c).alias(n) for n, (fn, c) in aggregates.items()])
    )
    earlier = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        key, "_slice", *[fn(F.col(n)).over(earlier).alias(f"_carry_{n}") for n, (fn, _) in aggregates.items()]
    )
    merged = local.join(carry, [key, "_slice"], "left")
    out = [F.col(c) for c in df.columns]
    for n in sums:
        out.append((F.col(n) + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n))
    for n in maxes:
        out.append(F.greatest(F.col(n), F.col(f"_carry_{n}")).alias(n))
    return merged.select(*out)


def laid_out(df: DataFrame, order: list[str], stage, name: str) -> DataFrame:
    """``df`` range-sorted along ``order`` in a written table, with ``_part`` and ``_at``.

    Partitions hold about equal numbers of rows whatever keys they belong to;
    ``order`` should be total, as equal rows stay together.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    written = stage(placed.select("*", F.monotonically_increasing_id().alias("_at")), name)
    return written.withColumn("_part", F.shiftright("_at", 33))


def prefixes(rows: DataFrame, key: str, aggregates: dict[str, tuple]) -> DataFrame:
    """Append running aggregates per key, current row included.

    ``aggregates``: name -> (aggregate, column, how two results combine).
    ``rows`` come from ``laid_out``, with the key first in their order. Every
    (key, partition) is scanned on its own and what the key's earlier
    partitions hold is combined with it: no task sees a whole key.
    """
    within = Window.partitionBy(key, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[fn(c).over(within).alias(n) for n, (fn, c, _) in aggregates.items()])
    totals = rows.groupBy(key, "_part").agg(*[fn(c).alias(n) for n, (fn, c, _) in aggregates.items()])
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(key, "_part", *[fn(F.col(n)).over(earlier).alias(f"_carry_{n}") for n, (fn, _, _) in aggregates.items()])
    merged = local.join(carry, [key, "_part"])
    kept = [F.col(c) for c in rows.columns]
    return merged.select(
        *kept,
        *[F.when(F.col(f"_carry_{n}").isNull(), F.col(n)).otherwise(both(F.col(n), F.col(f"_carry_{n}"))).alias(n) for n, (_, _, both) in aggregates.items()],
    )


def global_index(df: DataFrame, order: list[Column], name: str, stage) -> DataFrame:
    """Dense 0-based index along ``order`` without a single-task window.

    A range sort spreads the rows; only one count per partition is combined.
    """
    placed = stage(
        df.orderBy(*order).select(
            "*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_mid")
        ),
        "sorted",
    )
    local = F.col("_mid").bitwiseAND(F.lit(2**33 - 1))
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return placed.join(F.broadcast(offsets), "_pid").select(
        *df.columns, (F.col("_offset") + local).alias(name)
    )
