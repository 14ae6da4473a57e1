"""Leakage-free splits: identity components dealt out to train/calibration/test."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave import config as C
from ringweave.functions.normalize import with_entities
from ringweave.operators.scan import global_index

RAW_KEYS = (("vpa", "upi_vpa"), ("phone", "phone"), ("device", "device_id"), ("email", "email"))
NORMALIZED_KEYS = (("vpa", "upi_entity"), ("phone", "phone_entity"), ("device", "device_entity"), ("email", "email_entity"))


def identity_keys(events: DataFrame, normalized: bool = False) -> DataFrame:
    """(event_id, customer_id, key): customer and identity keys, no merchants."""
    source = with_entities(events) if normalized else events
    columns = NORMALIZED_KEYS if normalized else RAW_KEYS
    keys = [F.concat(F.lit("customer:"), F.col("customer_id"))]
    keys += [F.when(F.length(c) > 0, F.concat(F.lit(f"{name}:"), F.col(c))) for name, c in columns]
    return source.select("event_id", "customer_id", F.explode(F.array_compact(F.array(*keys))).alias("key"))


def identity_components(keys: DataFrame, stage: Callable) -> DataFrame:
    """(customer_id, component): connected customers, named by the smallest id.

    By contraction. A key becomes links from its customers to the smallest of
    them. Each round hooks every customer to its smallest neighbour, follows
    the hooks to the customers that have no smaller one, and rewrites the links
    to those: hooked customers and links inside a group leave, repeated links
    merge. Rounds end when no link is left; the hooks are then read backwards.
    A key or customer with very many links is only ever combined to a minimum
    or joined to one row.
    """
    links = stage(keys.where(~F.col("key").startswith("customer:")).select("customer_id", "key").distinct(), "identity_links")
    least = links.groupBy("key").agg(F.min("customer_id").alias("b"))
    edges = links.join(least, "key").select(F.col("customer_id").alias("a"), "b").where("a <> b").distinct()
    edges = stage(edges, "component_links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        hooks = _followed(stage(hooks, "component_hooks"), stage)
        rounds.append(hooks)
        left = edges.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        ends = left.join(hooks.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = stage(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "component_links")
    customers = keys.select("customer_id").distinct()
    if not rounds:
        return stage(customers.withColumn("component", F.col("customer_id")), "components")
    labels = rounds.pop()
    while rounds:  # the later rounds' few customers name the roots of the earlier ones
        later = labels.select(F.col("node").alias("root"), F.col("root").alias("final"))
        labels = stage(rounds.pop().join(later, "root", "left").select("node", F.coalesce("final", "root").alias("root")), "component_hooks")
    named = customers.join(labels.withColumnRenamed("node", "customer_id"), "customer_id", "left")
    return stage(named.select("customer_id", F.coalesce("root", "customer_id").alias("component")), "components")


def _followed(hooks: DataFrame, stage: Callable) -> DataFrame:
    """Hooks that lead to customers without a smaller neighbour; path lengths halve each time."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("far"))
        moved = stage(hooks.join(up, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "component_hooks")
        hooks = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return hooks


# --- greedy allocation ------------------------------------------------------
def _pick(room: Sequence[float]) -> int:
    return max(range(len(room)), key=lambda i: room[i])


def allocation_plan(histogram: Sequence[tuple[int, int]], targets: Sequence[float]) -> list[tuple[int, int, int, list[int]]]:
    """Deal equal-size items, largest size first, each to the bin with most room.

    ``histogram`` has (size, items) by falling size. Returns segments
    (size, first item, items, repeating bin pattern). Equal items soon cycle
    through the bins, so a segment stands for any number of items: the driver
    handles sizes, never items.
    """
    counts = [0] * len(targets)
    plan: list[tuple[int, int, int, list[int]]] = []

    def room() -> list[float]:
        return [t - n for t, n in zip(targets, counts)]

    for size, items in histogram:
        done = 0
        while done < items:
            before = room()
            pattern: list[int] = []
            trial = list(counts)
            while len(pattern) < min(len(targets), items - done):
                pick = _pick([t - n for t, n in zip(targets, trial)])
                if pick in pattern:
                    break
                pattern.append(pick)
                trial[pick] += size
            idle = [before[i] for i in range(len(targets)) if i not in pattern]
            lowest = min(before[i] for i in pattern)
            repeats = (items - done) // len(pattern)
            if idle:
                # stay clear of the point where an idle bin would come in
                repeats = min(repeats, int((lowest - max(idle)) // size) - 2)
            spread = max(before[i] for i in pattern) - lowest
            if repeats < 1 or spread >= size:
                pattern, repeats = pattern[:1], max(1, _solo_run(before, pattern[0], size, items - done))
            for i in pattern:
                counts[i] += size * repeats
            plan.append((size, done, repeats * len(pattern), pattern))
            done += repeats * len(pattern)
    return plan


def _solo_run(room: Sequence[float], bin_: int, size: int, items: int) -> int:
    """How many items in a row surely go to one bin."""
    others = [r for i, r in enumerate(room) if i != bin_]
    return min(items, int((room[bin_] - max(others)) // size) - 2) if others else items


def _deal(
    sized: DataFrame, class_col: str, order: list[Column], targets: Callable[[str, int], Sequence[float]], stage: Callable
) -> DataFrame:
    """Add ``bin`` to rows (class, size, ...) dealt class by class, size falling."""
    indexed = stage(
        global_index(sized, [F.col(class_col), F.desc("size"), *order], "_g", stage), "dealt"
    )
    sizes = indexed.groupBy(class_col, "size").agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("items")).collect()
    segments = []
    for cls in sorted({r[class_col] for r in sizes}):
        rows = sorted((r for r in sizes if r[class_col] == cls), key=lambda r: -r["size"])
        population = sum(r["size"] * r["items"] for r in rows)
        start = {r["size"]: r["_g0"] for r in rows}
        plan = allocation_plan([(r["size"], r["items"]) for r in rows], targets(cls, population))
        segments += [(cls, size, start[size], first, first + n, pattern) for size, first, n, pattern in plan]
    spark = sized.sparkSession
    table = spark.createDataFrame(
        segments, f"`{class_col}` string, size long, _start long, _from long, _to long, _pattern array<int>"
    )
    offset = F.col("_g") - F.col("_start")
    return (
        indexed.join(table, [class_col, "size"])
        .where((offset >= F.col("_from")) & (offset < F.col("_to")))
        .withColumn("bin", F.get("_pattern", ((offset - F.col("_from")) % F.size("_pattern")).cast("int")))
        .drop("_g", "_start", "_from", "_to", "_pattern")
    )


def assign_splits(events: DataFrame, labels: DataFrame, components: DataFrame, stage: Callable) -> DataFrame:
    """(event_id, split): whole components, largest first, toward 60/20/20.

    Fraud and clean components are dealt separately; a component is classed by
    its first event and equal sizes are ordered by their first event.
    """
    seq = F.struct(F.unix_micros("ts").alias("us"), "event_id")
    tagged = stage(
        events.select("event_id", "customer_id", seq.alias("seq"))
        .join(labels.select("event_id", "is_fraud"), "event_id")
        .join(components, "customer_id"),
        "tagged",
        "zstd",
    )
    dealt = component_splits(tagged, F.count(F.lit(1)), stage)
    return tagged.select("event_id", "component").join(dealt, "component").select("event_id", "split")


def component_splits(tagged: DataFrame, size: Column, stage: Callable) -> DataFrame:
    """(component, split) of events with component, ``seq`` and is_fraud; ``size`` counts a component's events."""
    sized = tagged.groupBy("component").agg(size.alias("size"), F.min(F.struct("seq", "is_fraud")).alias("first")).select("component", "size", "first.seq", F.when(F.col("first.is_fraud"), "fraud").otherwise("clean").alias("class"))
    names = [s for s, _ in C.TARGET_SHARES]
    dealt = _deal(sized, "class", [F.col("seq")], lambda _c, n: [share * n for _, share in C.TARGET_SHARES], stage)
    split = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("bin") + 1)
    return dealt.select("component", split.alias("split"))


def labels_by_customer(timeline: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with their event's customer, for a timeline in which no event id has two customers.

    ``n`` and ``us`` are the event's rows there and its first time, ``copies``
    the rows that joining labels, events and labels again on the id gives one label.
    """
    undated = F.count("ts_us") < F.count(F.lit(1))  # a missing time comes first
    owners = timeline.groupBy("customer_id", "event_id").agg(
        F.count(F.lit(1)).alias("n"), F.when(~undated, F.min("ts_us")).alias("us")
    )
    alike = F.count(F.lit(1)).over(Window.partitionBy("event_id"))
    return labels.withColumn("m", alike).join(owners, "event_id").withColumn("copies", F.col("n") * F.col("m")).drop("m")


def splits_by_customer(labels: DataFrame, components: DataFrame, buckets: int, stage: Callable) -> DataFrame:
    """(customer_id, split): ``assign_splits`` of labels in ``buckets`` customer buckets, from ``labels_by_customer``."""
    seq = F.struct("us", "event_id").alias("seq")
    tagged = labels.select("customer_id", seq, "is_fraud", "n").join(components.repartition(buckets, "customer_id"), "customer_id")
    dealt = component_splits(tagged, F.sum("n"), stage)
    return components.join(dealt, "component").select("customer_id", "split").repartition(buckets, "customer_id")


def identity_leakage_check(keys: DataFrame, splits: DataFrame) -> DataFrame:
    """Keys seen in more than one split."""
    return (
        keys.join(splits, "event_id")
        .groupBy("key")
        .agg(F.count_distinct("split").alias("splits"))
        .where("splits > 1")
    )


def ring_group(ring_id: Column, customer_id: Column) -> Column:
    """Cross-validation group: the ring, or the customer."""
    return F.coalesce(ring_id, F.concat(F.lit("cust:"), customer_id))


def group_kfold(rows: DataFrame, folds: int, stage: Callable, group: str = "cv_group") -> DataFrame:
    """(group, fold): groups by falling size to the lightest fold."""
    sized = rows.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("_class", F.lit("all"))
    dealt = _deal(sized, "_class", [F.col(group)], lambda _c, _n: [0.0] * folds, stage)
    return dealt.select(group, F.col("bin").cast("long").alias("fold"))
