"""Entity counts as they stood at each touch of the entity.

``merchant_count`` of an entity is the number of merchants of all its customers
and is refreshed only when an event touches the entity; readers see the value
of the last touch.  It is built without listing entity x merchant pairs of a
customer: each shared entity has an *anchor*, its customer with most merchants,
whose merchants are counted by a running total; only the other customers'
merchants are listed, and only while the anchor has not reached them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave import config as C
from ringweave.functions.normalize import node_value
from ringweave.operators.links import explode_entities
from ringweave.operators.scan import global_index, hot_keys, running, union_by
from ringweave.session import stage

DELTA, TOUCH, PROBE = 0, 1, 2


PROGRESS_COLUMNS = ("event_id", "customer_id", "amount_paise", "ts_us", "vts", *C.ENTITY_TYPES, "ord")


def event_progress(tl: DataFrame, links: DataFrame, stage, most_events: int | None = None, **scan) -> DataFrame:
    """Timeline (what is read of it later) plus the customer's running merchants, payments and amount.

    A customer's first payment at a merchant is a step on its own timeline, so
    events need no join to learn that they are first.
    """
    tl = tl.select(*PROGRESS_COLUMNS)
    empty = [F.lit(None).cast(t).alias(c) for c, t in tl.dtypes if c not in ("customer_id", "vts", "ord")]
    firsts = links.where(F.col("ntype") == "merchant").select(
        "customer_id",
        F.col("fl_vts").alias("vts"),
        F.col("fl_ord").alias("ord"),
        *empty,
        F.lit(DELTA).alias("kind"),
        F.lit(1).alias("new_merchant"),
    )
    rows = union_by("customer_id", tl.select("*", F.lit(TOUCH).alias("kind"), F.lit(0).alias("new_merchant")), firsts)
    scanned = running(
        rows,
        "customer_id",
        ["vts", "ord", "kind"],
        sums={
            "own_merchants": F.col("new_merchant"),
            "amount_sum": F.coalesce("amount_paise", F.lit(0)),
            "amount_count": (F.col("kind") == TOUCH).cast("long"),
        },
        load=None if most_events is None else 2 * most_events,
        stage=stage,
        name="progress_in",
        **scan,
    )
    return scanned.where(F.col("kind") == TOUCH).drop("kind", "new_merchant")


SNAPSHOT_COLUMNS = ("node", "ntype", "event_id", "vts", "ord", "merchant_count", "linked_identity_count")


def entity_snapshot_history(
    links: DataFrame, progress: DataFrame, stage, keep: Callable | None = None, buckets: int = 0, **scan
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shared, alone, joint links): one row of ``SNAPSHOT_COLUMNS`` per touch of an entity.

    An entity of one customer has that customer's own count, so only touches
    of shared ones go through scans; those of the others also have their
    customer_id. ``links`` and ``progress`` may lie in ``buckets`` customer
    buckets, in which ``keep`` stages.
    """
    entity_links = links.where(F.col("ntype") != "merchant")
    merchant_links = links.where(F.col("ntype") == "merchant")
    breadth = merchant_links.groupBy("customer_id").agg(F.count(F.lit(1)).alias("breadth"))
    broad = F.when(F.col("breadth").isNotNull(), F.struct("breadth", "customer_id"))
    joint = stage(
        entity_links.join(breadth, "customer_id", "left")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("_all"), F.count("breadth").alias("_n"), F.max(broad).alias("a"))
        .where("_all > 1")
        .select("node", F.when(F.col("_n") > 1, F.col("a.customer_id")).alias("anchor")),
        "anchors",
    )
    shared = joint.where("anchor is not null")
    joint_links = stage(
        entity_links.select("customer_id", "ntype", "node", "fl_ord", "fl_vts").join(joint, "node"), "joint_links"
    )
    anchor_link = joint_links.where("customer_id = anchor").select(
        "node", "anchor", F.col("fl_ord").alias("a_ord"), F.col("fl_vts").alias("a_vts")
    )
    touched = explode_entities(progress, merchants=False, extra=("own_merchants",)).drop("ts_us")
    marks = joint_links.select("customer_id", "node", F.lit(True).alias("joint"))
    if buckets:
        # a mark beside the touches of its customer and node: no touch is shuffled
        blank = [F.lit(None).cast(t).alias(c) for c, t in touched.dtypes if c not in ("customer_id", "node")]
        beside = union_by(
            "customer_id",
            touched.withColumn("joint", F.lit(None).cast("boolean")),
            marks.repartition(buckets, "customer_id").select("customer_id", "node", "joint", *blank),
        )
        link = Window.partitionBy("customer_id", "node")
        marked = beside.withColumns({"joint": F.max("joint").over(link), "fl_vts": F.min("vts").over(link)}).where("ord is not null")
    else:
        every = entity_links.select("customer_id", "node", "fl_vts").join(joint.select("node", F.lit(True).alias("joint")), "node", "left")
        marked = touched.join(every, (touched.node == every.node) & touched.customer_id.eqNullSafe(every.customer_id)).select(
            *[touched[c] for c in touched.columns], "joint", "fl_vts"
        )
    marked = (keep or stage)(marked, "touches")
    linked = F.col("vts").isNotNull() | F.col("fl_vts").isNull()  # touches without a time come before a dated link
    alone = marked.where("joint is null").select(
        "customer_id", "node", "ntype", "event_id", "vts", "ord", F.col("own_merchants").alias("merchant_count"), linked.cast("long").alias("linked_identity_count")
    )
    touches = (
        marked.where("joint")
        .join(anchor_link, "node", "left")
        .select("event_id", "customer_id", "ntype", "node", "vts", "ord", "own_merchants", "anchor", "a_ord")
    )

    # touches of a shared entity by someone else read the anchor's total
    foreign = touches.where("anchor is not null and customer_id <> anchor and a_ord <= ord").select(
        F.col("anchor").alias("customer_id"), "vts", "ord", F.lit(PROBE).alias("kind"), F.lit(0).alias("d"), "node"
    )
    steps = (
        merchant_links.join(shared.select(F.col("anchor").alias("customer_id")).distinct(), "customer_id", "left_semi")
        .select(
            "customer_id",
            F.col("fl_vts").alias("vts"),
            F.col("fl_ord").alias("ord"),
            F.lit(DELTA).alias("kind"),
            F.lit(1).alias("d"),
            F.lit(None).cast("string").alias("node"),
        )
    )
    anchored = (
        running(
            stage(steps.unionByName(foreign), "anchor_in"),
            "customer_id",
            ["vts", "ord", "kind"],
            sums={"anchor_merchants": F.col("d")},
            **scan,
        )
        .where(F.col("kind") == PROBE)
        .select("node", "ord", "anchor_merchants")
    )
    own_base = F.when(F.col("anchor").isNull() | (F.col("customer_id") == F.col("anchor")), F.col("own_merchants"))
    based = touches.join(anchored, ["node", "ord"], "left").select(
        "node",
        "ntype",
        "event_id",
        "vts",
        "ord",
        F.lit(TOUCH).alias("kind"),
        F.coalesce(own_base, "anchor_merchants", F.lit(0)).cast("long").alias("base"),
        F.lit(0).alias("d_merchants"),
        F.lit(0).alias("d_customers"),
    )

    # merchants reached through the other customers, until the anchor reaches them
    listed = joint_links.where("customer_id <> anchor").select("customer_id", "node", "fl_ord", "fl_vts")
    others = (
        (listed.repartition(buckets, "customer_id") if buckets else listed)
        .join(
            merchant_links.select(
                "customer_id", F.col("node").alias("merchant"), F.col("fl_ord").alias("m_ord"), F.col("fl_vts").alias("m_vts")
            ),
            "customer_id",
        )
        .groupBy("node", "merchant")
        .agg(
            F.min(F.greatest("fl_ord", "m_ord")).alias("from_ord"),
            F.min(F.greatest("fl_vts", "m_vts")).alias("from_vts"),
        )
        .join(anchor_link, "node")
        .join(
            merchant_links.select(
                F.col("customer_id").alias("anchor"),
                F.col("node").alias("merchant"),
                F.col("fl_ord").alias("am_ord"),
                F.col("fl_vts").alias("am_vts"),
            ),
            ["anchor", "merchant"],
            "left",
        )
        .withColumn("to_ord", F.when(F.col("am_ord").isNotNull(), F.greatest("a_ord", "am_ord")))
        .withColumn("to_vts", F.when(F.col("am_ord").isNotNull(), F.greatest("a_vts", "am_vts")))
        .where("to_ord is null or from_ord < to_ord")
    )
    edge = F.filter(
        F.array(
            F.struct(F.col("from_vts").alias("vts"), F.col("from_ord").alias("ord"), F.lit(1).alias("d")),
            F.struct(F.col("to_vts").alias("vts"), F.col("to_ord").alias("ord"), F.lit(-1).alias("d")),
        ),
        lambda e: e["ord"].isNotNull(),
    )

    def steps_of(df: DataFrame, d_merchants: Column, d_customers: Column) -> DataFrame:
        return df.select(
            "node",
            F.lit(None).cast("string").alias("ntype"),
            F.lit(None).cast("string").alias("event_id"),
            "vts",
            "ord",
            F.lit(DELTA).alias("kind"),
            F.lit(0).cast("long").alias("base"),
            d_merchants.alias("d_merchants"),
            d_customers.alias("d_customers"),
        )

    deltas = steps_of(others.select("node", F.inline(edge).alias("vts", "ord", "d")), F.col("d"), F.lit(0))
    joiners = steps_of(
        joint_links.select("node", F.col("fl_vts").alias("vts"), F.col("fl_ord").alias("ord")), F.lit(0), F.lit(1)
    )
    scanned = (
        running(
            stage(based.unionByName(deltas).unionByName(joiners), "snapshot_in", "zstd"),
            "node",
            ["vts", "ord", "kind"],
            sums={"_m": F.col("d_merchants"), "linked_identity_count": F.col("d_customers")},
            **scan,
        )
        .where(F.col("kind") == TOUCH)
        .select(
            "node", "ntype", "event_id", "vts", "ord", (F.col("base") + F.col("_m")).alias("merchant_count"), "linked_identity_count"
        )
    )
    return scanned, alone, joint_links


def _asked(history: DataFrame, probes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Touches and probes in one form; what a probe has beside node and position names it."""
    place = ("node", "vts", "ord")
    names = [F.lit(None).cast(t).alias(c) for c, t in probes.dtypes if c not in (*place, *history.columns)]
    if "event_id" in history.columns:
        history = history.withColumn("event_id", F.lit(None).cast("string"))
    seen = history.select(
        *place, *names, *[c for c in probes.columns if c not in place and c in history.columns], F.lit(TOUCH).alias("kind"), "merchant_count", "linked_identity_count"
    )
    nothing = F.lit(None).cast("long")
    return seen, probes.select("*", F.lit(PROBE).alias("kind"), nothing.alias("merchant_count"), nothing.alias("linked_identity_count"))


def read_snapshots(history: DataFrame, probes: DataFrame, stage, load: int | None = None, **scan) -> DataFrame:
    """Counts as of each probe (node, vts, ord and what names it): last touch at or before.

    Both counts only grow, so the last touch is the running maximum.
    """
    seen, asks = _asked(history, probes)
    scanned = running(
        seen.unionByName(asks),
        "node",
        ["vts", "ord", "kind"],
        maxes={"mc": F.col("merchant_count"), "lic": F.col("linked_identity_count")},
        load=load,
        stage=stage,
        name="snapshot_reads",
        **scan,
    )
    return _answers(scanned, probes)


def _answers(scanned: DataFrame, probes: DataFrame) -> DataFrame:
    return scanned.where(F.col("kind") == PROBE).select(
        *[c for c in probes.columns if c not in ("vts", "ord")],
        F.coalesce("mc", F.lit(0)).alias("merchant_count"),
        F.coalesce("lic", F.lit(0)).alias("linked_identity_count"),
    )


def widest_entities(reads: DataFrame, *event: str) -> DataFrame:
    """Per event: largest merchant count, and its top three devices by linked
    identities (at most one cluster's entities per event are combined)."""
    device = F.struct(
        (-F.col("linked_identity_count")).alias("neg_identities"),
        node_value(F.col("node")).alias("device_id"),
        "merchant_count",
    )
    devices = F.collect_list(F.when(F.col("node").startswith("device:"), device))
    return reads.groupBy(*(event or ("event_id",))).agg(
        F.max("merchant_count").alias("max_fanout"), F.slice(F.array_sort(devices), 1, 3).alias("top_devices")
    )


def cluster_reads(
    targets: DataFrame,
    fan: DataFrame,
    history: DataFrame,
    stage,
    busy_events: int,
    epoch_gain: float,
    **scan,
) -> DataFrame:
    """(event_id, max_fanout, top_devices) of every event's cluster, as of it.

    ``fan`` are the memberships of the entities to read. An ordinary customer
    asks for each of them at each event. A customer with very many events asks
    once per *epoch*: between two changes of its cluster or of its entities'
    counts all events read the same values.
    """
    events = targets.select("event_id", "customer_id", "vts", "ord")
    busy = hot_keys(events, "customer_id", busy_events)
    steady = None
    if busy is not None:
        steady = stage(_worth_epochs(events, fan, history, busy, epoch_gain), "steady")
        if steady.isEmpty():
            steady = None
    plain = events if steady is None else events.join(steady, "customer_id", "left_anti")
    probes = plain.join(fan, "customer_id").where("in_ord <= ord and ord < out_ord").select("node", "event_id", "vts", "ord")
    read = widest_entities(read_snapshots(history, probes, stage, **scan))
    if steady is None:
        return read

    mine = stage(fan.join(steady, "customer_id", "left_semi"), "steady_fan")
    known = mine.join(_changes(history), "node").where("c_ord < out_ord")
    moments = (
        known.select("customer_id", F.greatest("in_vts", "c_vts").alias("vts"), F.greatest("in_ord", "c_ord").alias("ord"))
        .unionByName(mine.select("customer_id", F.col("in_vts").alias("vts"), F.col("in_ord").alias("ord")))
        .unionByName(mine.where(F.col("out_ord") < C.FOREVER).select("customer_id", F.col("out_vts").alias("vts"), F.col("out_ord").alias("ord")))
        .distinct()
    )
    epochs = stage(moments.withColumn("epoch", F.to_json(F.struct("customer_id", "ord"))), "epochs")
    asks = epochs.join(mine, "customer_id").where("in_ord <= ord and ord < out_ord").select(
        "node", F.col("epoch").alias("event_id"), "vts", "ord"
    )
    per_epoch = widest_entities(read_snapshots(history, asks, stage, **scan)).withColumnRenamed("event_id", "epoch")
    timeline = epochs.select("customer_id", "vts", "ord", F.lit(DELTA).alias("kind"), F.col("ord").alias("e_ord"), F.lit(None).cast("string").alias("event_id"))
    own = events.join(steady, "customer_id", "left_semi").select(
        "customer_id", "vts", "ord", F.lit(PROBE).alias("kind"), F.lit(None).cast("long").alias("e_ord"), "event_id"
    )
    placed = running(
        stage(timeline.unionByName(own), "epoch_in"), "customer_id", ["vts", "ord", "kind"], maxes={"epoch_ord": F.col("e_ord")}, **scan
    ).where(F.col("kind") == PROBE)
    shared = placed.select("event_id", F.to_json(F.struct("customer_id", F.col("epoch_ord").alias("ord"))).alias("epoch")).join(per_epoch, "epoch")
    return read.unionByName(shared.select(*read.columns))


def kept_reads(
    targets: DataFrame,
    fan: DataFrame,
    links: DataFrame,
    history: tuple[DataFrame, DataFrame, DataFrame],
    sizes: DataFrame,
    most_events: int,
    stage,
    buckets: int,
    **scan,
) -> DataFrame:
    """(customer_id, event_id, max_fanout, top_devices): ``cluster_reads`` in customer buckets.

    Entities that nobody else uses are read by their customer where they lie.
    Only reads of the others are sent to the entity, and touches of a private
    one only if its customer shares another: otherwise no one else reaches it.
    ``history`` as in ``entity_snapshot_history``, ``sizes`` has each
    customer's ``event_count``, none above ``most_events``.
    """
    shared, alone, joint_links = history
    link = ["customer_id", "node"]
    events = targets.select("event_id", "customer_id", "vts", "ord")
    marks = joint_links.select(*link).repartition(buckets, "customer_id")
    private = links.where(F.col("ntype").isin(*C.FANOUT_TYPES)).select(*link).join(marks, link, "left_anti")
    alone = alone.where(F.col("ntype").isin(*C.FANOUT_TYPES))

    def asked(entities: DataFrame) -> DataFrame:
        return events.join(entities, "customer_id").where("in_ord <= ord and ord < out_ord").select(*link, "event_id", "vts", "ord")

    asks = asked(fan.join(private, link, "left_semi"))
    along = Window.partitionBy(*link).orderBy("vts", "ord", "kind").rowsBetween(Window.unboundedPreceding, 0)
    own = union_by("customer_id", *_asked(alone, asks)).withColumns(
        {"mc": F.max("merchant_count").over(along), "lic": F.max("linked_identity_count").over(along)}
    )
    others = fan.join(private, link, "left_anti")
    reached = alone.join(marks.select("customer_id").distinct(), "customer_id", "left_semi").select(*SNAPSHOT_COLUMNS)
    far = asked(others)
    load = _reads_load(others, sizes) + most_events
    read = read_snapshots(shared.unionByName(reached), far, stage, load=load, **scan).repartition(buckets, "customer_id")
    return widest_entities(union_by("customer_id", _answers(own, asks), read), "customer_id", "event_id")


def _reads_load(fan: DataFrame, sizes: DataFrame) -> int:
    """Touches and reads of the entity with most, from above: each is an event of a customer in whose cluster it is."""
    reads = fan.join(sizes.select("customer_id", "event_count"), "customer_id").groupBy("node").agg(F.sum("event_count").alias("n"))
    return 2 * (reads.agg(F.max("n")).first()[0] or 0)


def _changes(history: DataFrame) -> DataFrame:
    """First touch at each value of an entity's counts (both only grow)."""
    return history.groupBy("node", "merchant_count", "linked_identity_count").agg(
        F.min("vts").alias("c_vts"), F.min("ord").alias("c_ord")
    )


def _worth_epochs(events: DataFrame, fan: DataFrame, history: DataFrame, busy: DataFrame, gain: float) -> DataFrame:
    """Busy customers whose clusters change far less often than they pay."""
    sizes = events.join(busy, "customer_id").groupBy("customer_id").agg(F.count("*").alias("n_events"))
    per_node = _changes(history).groupBy("node").agg(F.count("*").alias("changes"))
    cost = fan.join(busy, "customer_id").join(per_node, "node").groupBy("customer_id").agg(F.sum(F.col("changes") + 2).alias("changes"))
    return sizes.join(cost, "customer_id").where(F.col("changes") * F.lit(gain) <= F.col("n_events")).select("customer_id")


def current_counts(links: DataFrame) -> DataFrame:
    """Final counts per entity (freshness = current)."""
    entity_links = links.where(F.col("ntype") != "merchant").select("customer_id", "ntype", "node")
    merchants = links.where(F.col("ntype") == "merchant").select("customer_id", F.col("node").alias("merchant"))
    degree = entity_links.groupBy("ntype", "node").agg(F.count(F.lit(1)).alias("linked_identity_count"))
    return degree.join(merchant_unions(entity_links.select("customer_id", "node"), merchants), "node")


def merchant_unions(entity_links: DataFrame, merchants: DataFrame, dense: int = C.DENSE_MERCHANTS) -> DataFrame:
    """``node, merchant_count``: different merchants of an entity's customers.

    Merchants get dense numbers, and a customer's numbers are held in blocks
    of 32,768. A block with ``dense`` or more of them is one bitmap, one with
    fewer lists them, so a link brings at most ``dense`` rows a block. Entities
    of one customer take that customer's count. Both inputs hold a pair once.
    """
    numbers = global_index(merchants.select("merchant").distinct(), [F.col("merchant")], "no", stage)
    uses = merchants.join(numbers, "merchant").select(
        "customer_id", F.bitmap_bucket_number(F.col("no") + 1).alias("block"), F.bitmap_bit_position(F.col("no") + 1).alias("bit")
    )
    uses = stage(uses, "merchant_numbers")
    own = uses.groupBy("customer_id").agg(F.count("*").alias("merchant_count"))
    few = entity_links.groupBy("node").agg(F.count("*").alias("customers"), F.min("customer_id").alias("customer_id"))
    single = few.where("customers = 1").join(own, "customer_id").select("node", "merchant_count")

    shared = entity_links.join(few.where("customers > 1").select("node"), "node").select("node", "customer_id")
    sizes = uses.groupBy("customer_id", "block").agg(F.count("*").alias("size"))
    full = sizes.where(F.col("size") >= dense).select("customer_id", "block")
    maps = uses.join(full, ["customer_id", "block"], "left_semi").groupBy("customer_id", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    maps = stage(shared.join(maps, "customer_id").groupBy("node", "block").agg(F.bitmap_or_agg("bits").alias("bits")), "merchant_bitmaps")
    listed = uses.join(full, ["customer_id", "block"], "left_anti")
    listed = stage(shared.join(listed, "customer_id").select("node", "block", "bit").distinct(), "merchant_lists")
    beside = listed.join(maps.select("node", "block"), ["node", "block"], "left_semi").groupBy("node", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    united = maps.unionByName(beside).groupBy("node", "block").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    plain = listed.join(maps.select("node", "block"), ["node", "block"], "left_anti").groupBy("node", "block").agg(F.count("*").alias("n"))
    counted = united.unionByName(plain).groupBy("node").agg(F.sum("n").alias("merchant_count"))
    return single.unionByName(counted)
