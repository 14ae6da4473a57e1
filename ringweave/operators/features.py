"""The seven ring features of every event, exact as of the event.

Each cluster quantity is a step function of time: a node or a state adds +1
when it appears in a customer's cluster and -1 when it leaves.  All steps of a
customer and its events go through one running-sum scan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave import config as C
from ringweave.functions.scoring import clip01, half_even
from ringweave.operators.links import fraud_times
from ringweave.operators.scan import hot_keys, running, union_by

COUNTERS = (
    "n_customer",
    "n_device",
    "n_upi",
    "n_phone",
    "n_email",
    "n_merchant",
    "n_fresh",
    "n_active_merchants",
    "n_off_band",
    "n_burn_rotate",
    "n_taint_0",
    "n_taint_1",
    "n_taint_2",
    "n_taint_3",
)
KIND = {name: i for i, name in enumerate(COUNTERS)}
STEP = "customer_id string, vts long, ord long, kind int, d int"


def _pos(vts: str, ord_: str) -> Column:
    return F.struct(F.col(vts).alias("vts"), F.col(ord_).alias("ord"))


def _const(vts: int, ord_: int) -> Column:
    return F.struct(F.lit(vts).cast("long").alias("vts"), F.lit(ord_).cast("long").alias("ord"))


NEVER = (C.FOREVER, C.FOREVER)


def _interval_steps(df: DataFrame, kind: Column, start: Column, end: Column) -> DataFrame:
    """+1 at start and -1 at end (when it ends) for rows with start < end."""
    ends = F.filter(
        F.array(
            F.struct(F.col("_a.vts").alias("vts"), F.col("_a.ord").alias("ord"), F.lit(1).alias("d")),
            F.struct(F.col("_b.vts").alias("vts"), F.col("_b.ord").alias("ord"), F.lit(-1).alias("d")),
        ),
        lambda e: e["vts"] < C.FOREVER,
    )
    return (
        df.select("customer_id", kind.cast("int").alias("kind"), start.alias("_a"), end.alias("_b"))
        .where("_a < _b")
        .select("customer_id", "kind", F.inline(ends).alias("vts", "ord", "d"))
        .select("customer_id", "vts", "ord", "kind", "d")
    )


def _pushed_steps(df: DataFrame, kind: Column, at: Column, d: Column) -> DataFrame:
    """Steps of a member's own state, shown only inside its membership."""
    inn, out = _pos("in_vts", "in_ord"), _pos("out_vts", "out_ord")
    ends = F.filter(
        F.array(
            F.struct(F.col("_a.vts").alias("vts"), F.col("_a.ord").alias("ord"), F.col("_d").alias("d")),
            F.struct(F.col("_b.vts").alias("vts"), F.col("_b.ord").alias("ord"), (-F.col("_d")).alias("d")),
        ),
        lambda e: e["vts"] < C.FOREVER,
    )
    return df.select(
        "customer_id",
        kind.cast("int").alias("kind"),
        F.greatest(inn, at).alias("_a"),
        F.greatest(out, at).alias("_b"),
        d.cast("int").alias("_d"),
    ).select("customer_id", "kind", F.inline(ends).alias("vts", "ord", "d")).select("customer_id", "vts", "ord", "kind", "d")


def member_steps(members: DataFrame) -> DataFrame:
    kind = F.element_at(
        F.create_map(*[x for t in C.NODE_TYPES for x in (F.lit(t), F.lit(KIND[f"n_{t}"]))]), F.col("ntype")
    )
    return _interval_steps(members, kind, _pos("in_vts", "in_ord"), _pos("out_vts", "out_ord"))


def taint_steps(members: DataFrame, taint: DataFrame) -> DataFrame:
    tainted = members.where(F.col("ntype") != "merchant").join(taint, "node")
    kind = F.col("hop") + F.lit(KIND["n_taint_0"])
    start = F.greatest(_pos("in_vts", "in_ord"), _pos("t_vts", "t_ord"))
    return _interval_steps(tainted, kind, start, _pos("out_vts", "out_ord"))


def cluster_customers(members: DataFrame) -> DataFrame:
    return members.where(F.col("ntype") == "customer").withColumn("member_id", F.expr("substring(node, 10)"))


def of_members(people: DataFrame, theirs: DataFrame, buckets: int, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``read`` makes of ``people`` joined with what ``theirs`` has of each member.

    In customer buckets a customer's own rows meet without a shuffle, and only
    what was read of the others in its cluster is sent to it.
    """
    if not buckets:
        return read(people.join(theirs, "member_id"))
    own = people.where("member_id = customer_id").drop("member_id").join(theirs.withColumnRenamed("member_id", "customer_id"), "customer_id")
    asked = people.where("member_id <> customer_id").repartition(buckets, "member_id")  # theirs stay where they are
    return union_by("customer_id", read(own), read(asked.join(theirs, "member_id")).repartition(buckets, "customer_id"))


def fresh_steps(people: DataFrame, customers: DataFrame, buckets: int = 0) -> DataFrame:
    stale = F.struct((F.col("first_seen_us") + C.NEW_IDENTITY_US).alias("vts"), F.lit(C.FOREVER).alias("ord"))

    def read(known: DataFrame) -> DataFrame:
        return _interval_steps(
            known, F.lit(KIND["n_fresh"]), _pos("in_vts", "in_ord"), F.least(_pos("out_vts", "out_ord"), stale)
        )

    return of_members(people, customers.select(F.col("customer_id").alias("member_id"), "first_seen_us"), buckets, read)


def _day(us: Column) -> Column:
    return F.floor(us / F.lit(86_400 * C.SECOND)).cast("int")


def payment_spans(tl: DataFrame) -> DataFrame:
    """Payments of a customer at a merchant on one day cover one unbroken span
    of the velocity window, so a day is one row."""
    return tl.groupBy("customer_id", "merchant", "epoch_rank", _day(F.col("ts_us")).alias("day")).agg(
        F.min("vts").alias("s_vts"), F.min("ord").alias("s_ord"), (F.max("ts_us") + C.VELOCITY_US).alias("e_vts")
    )


def _span_end() -> Column:
    return F.struct(F.col("e_vts").alias("vts"), F.lit(C.FOREVER).alias("ord"))


def _merged(intervals: DataFrame) -> DataFrame:
    """Union of [a, b) per (customer_id, merchant); rows are days, not events."""
    w = Window.partitionBy("customer_id", "merchant").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = intervals.withColumn("_new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0)).withColumn(
        "_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    merged = islands.groupBy("customer_id", "merchant", "_island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.drop("_island")


def velocity(
    people: DataFrame, tl: DataFrame, targets: DataFrame, stage, heavy_spans: int, buckets: int = 0, keep=None, **scan
) -> tuple[DataFrame, DataFrame | None]:
    """Merchants used by a cluster customer within the window, counted once.

    Returns steps, and per event (event_id, anchor_active) to add to them, or
    None. Spans that cover no day with an event of the center are dropped inside
    the join; the others are merged per center and merchant.

    A heavy customer would repeat its merchants in every cluster it belongs to.
    It is the *anchor* of those clusters instead: its own number of active
    merchants is scanned once and read at each event, and the other customers
    add only what the anchor is not using at the time.
    """
    active = targets.groupBy("customer_id").agg(F.collect_set(_day(F.col("ts_us"))).alias("days"))
    spans = (keep or stage)(payment_spans(tl), "spans")  # by customer
    spans = spans.withColumnRenamed("customer_id", "member_id")
    heavy = hot_keys(spans, "member_id", heavy_spans)
    anchors = None
    rest = people
    if heavy is not None:
        weight = spans.join(heavy, "member_id").groupBy("member_id").agg(F.count("*").alias("weight"))
        chosen = people.join(weight, "member_id").groupBy("customer_id").agg(
            F.max(F.struct("weight", "member_id", _pos("in_vts", "in_ord").alias("a_in"), _pos("out_vts", "out_ord").alias("a_out"))).alias("p")
        )
        anchors = stage(chosen.select("customer_id", F.col("p.member_id").alias("anchor"), "p.a_in", "p.a_out"), "velocity_anchors")
        rest = people.join(
            anchors.select("customer_id", F.col("anchor").alias("member_id")), ["customer_id", "member_id"], "left_anti"
        )

    seen_some_day = F.arrays_overlap("days", F.sequence(F.col("day"), _day(F.col("e_vts"))))
    seen_later = F.array_min("days") <= _day(F.col("e_vts"))

    def read(paid: DataFrame) -> DataFrame:
        return (
            paid.where(F.when(F.col("epoch_rank") <= 0, seen_later).otherwise(seen_some_day))
            .select(
                "customer_id",
                "merchant",
                F.greatest(_pos("in_vts", "in_ord"), _pos("s_vts", "s_ord")).alias("a"),
                F.least(_pos("out_vts", "out_ord"), _span_end()).alias("b"),
            )
            .where("a < b")
        )

    seen = of_members(rest.join(active, "customer_id"), spans, buckets, read)
    kind = F.lit(KIND["n_active_merchants"])
    if anchors is None:
        return _interval_steps(_merged(seen), kind, F.col("a"), F.col("b")), None

    others = stage(_merged(seen), "velocity_others")
    own = spans.join(heavy, "member_id").select(
        F.col("member_id").alias("customer_id"), "merchant", _pos("s_vts", "s_ord").alias("a"), _span_end().alias("b")
    )
    used = stage(_merged(own), "velocity_heavy")
    both = (
        others.join(anchors, "customer_id")
        .join(used.select(F.col("customer_id").alias("anchor"), "merchant", F.col("a").alias("x"), F.col("b").alias("y")), ["anchor", "merchant"])
        .select("customer_id", F.greatest("a", "x", "a_in").alias("a"), F.least("b", "y", "a_out").alias("b"))
    )
    twice = _interval_steps(both, kind, F.col("a"), F.col("b")).withColumn("d", -F.col("d"))
    steps = _interval_steps(others, kind, F.col("a"), F.col("b")).unionByName(twice)

    own_steps = _interval_steps(used, F.lit(0), F.col("a"), F.col("b")).withColumn("event_id", F.lit(None).cast("string"))
    here = _pos("vts", "ord")
    reads = (
        targets.join(anchors, "customer_id")
        .where((F.col("a_in") <= here) & (here < F.col("a_out")))
        .select(F.col("anchor").alias("customer_id"), "vts", "ord", F.lit(1).alias("kind"), F.lit(0).alias("d"), "event_id")
    )
    scanned = running(
        stage(own_steps.unionByName(reads), "velocity_reads"),
        "customer_id",
        ["vts", "ord", "kind"],
        sums={"anchor_active": F.col("d")},
        **scan,
    )
    return steps, scanned.where("event_id is not null").select("event_id", "anchor_active")


def amount_steps(people: DataFrame, progress: DataFrame, buckets: int = 0) -> DataFrame:
    """Customers whose running mean amount lies outside the band."""
    lo, hi = C.AMOUNT_BAND_PAISE

    def off(total: Column, n: Column) -> Column:
        return ((total < n * lo) | (total > n * hi)).cast("int")

    now = off(F.col("amount_sum"), F.col("amount_count"))
    before_n = F.col("amount_count") - 1
    before = F.when(before_n > 0, off(F.col("amount_sum") - F.col("amount_paise"), before_n)).otherwise(0)
    flips = progress.select(
        F.col("customer_id").alias("member_id"), F.col("vts").alias("s_vts"), F.col("ord").alias("s_ord"), (now - before).alias("flip")
    ).where("flip <> 0")

    def read(paid: DataFrame) -> DataFrame:
        return _pushed_steps(paid, F.lit(KIND["n_off_band"]), _pos("s_vts", "s_ord"), F.col("flip"))

    return of_members(people, flips, buckets, read)


def burn_rotate_steps(
    members: DataFrame, people: DataFrame, customers: DataFrame, entities: DataFrame, tl: DataFrame
) -> DataFrame:
    """A fraud customer's handle last used within 48 h of its fraud, while the
    cluster holds a handle first seen after that fraud."""
    fraud = fraud_times(customers)
    uses = tl.where(F.col("upi").isNotNull()).select("customer_id", "upi", "ts_us", "vts", "ord").join(fraud, "customer_id")
    close = F.col("ts_us").between(F.col("fraud_us"), F.col("fraud_us") + C.BURN_ROTATE_US)
    past = F.col("ts_us") > F.col("fraud_us") + C.BURN_ROTATE_US
    ends = F.least(
        F.coalesce(F.when(F.col("p_ord").isNotNull(), _pos("p_vts", "p_ord")), _const(*NEVER)), _pos("to_vts", "to_ord")
    )
    abandoned = (
        uses.groupBy("customer_id", "upi", *fraud.columns[1:])
        .agg(
            F.min(F.when(close, F.col("vts"))).alias("u_vts"),
            F.min(F.when(close, F.col("ord"))).alias("u_ord"),
            F.min(F.when(past, F.col("vts"))).alias("p_vts"),
            F.min(F.when(past, F.col("ord"))).alias("p_ord"),
        )
        .where("u_ord is not null")
        .select(
            F.col("customer_id").alias("member_id"),
            "fraud_us",
            F.greatest(_pos("u_vts", "u_ord"), _pos("from_vts", "from_ord")).alias("from_pos"),
            ends.alias("to_pos"),
        )
    )
    burned = people.join(abandoned, "member_id").select(
        "customer_id",
        "member_id",
        "fraud_us",
        F.greatest(_pos("in_vts", "in_ord"), F.col("from_pos")).alias("a"),
        F.least(_pos("out_vts", "out_ord"), F.col("to_pos")).alias("b"),
    ).where("a < b")
    handles = (
        members.where(F.col("ntype") == "upi")
        .join(burned.select("customer_id").distinct(), "customer_id", "left_semi")
        .join(entities.where(F.col("ntype") == "upi").select("node", F.col("first_seen_us").alias("born_us")), "node")
        .select("customer_id", "born_us", _pos("in_vts", "in_ord").alias("h_in"), _pos("out_vts", "out_ord").alias("h_out"))
    )
    rotated = (
        burned.select("customer_id", "member_id", "fraud_us")
        .distinct()
        .join(handles, "customer_id")
        .where("born_us > fraud_us")
        .groupBy("customer_id", "member_id", "fraud_us", "h_out")
        .agg(F.min("h_in").alias("h_in"))
    )
    both = burned.join(rotated, ["customer_id", "member_id", "fraud_us"])
    return _interval_steps(
        both, F.lit(KIND["n_burn_rotate"]), F.greatest("a", "h_in"), F.least("b", "h_out")
    )


EVENT_COLUMNS = ("event_id", "merchant_id", "amount_paise", "epoch_rank")


def steps_load(people: DataFrame, customers: DataFrame, members: DataFrame) -> int:
    """Steps and events of the largest cluster, estimated from above: a member's payment
    makes up to six steps in it, a node of the cluster two and its taint levels two each."""
    paid = customers.select(F.col("customer_id").alias("member_id"), "event_count")
    theirs = people.join(paid, "member_id").groupBy("customer_id").agg(F.sum("event_count").alias("n"))
    nodes = members.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    most = theirs.agg(F.max("n")).first()[0] or 0
    return 7 * most + 10 * (nodes.agg(F.max("n")).first()[0] or 0)


def cluster_counters(targets: DataFrame, steps: DataFrame, stage, load: int | None = None, **scan) -> DataFrame:
    """Scored events with every counter of their cluster as of the event; ``load`` as in ``running``."""
    merged = steps.groupBy("customer_id", "vts", "ord", "kind").agg(F.sum("d").cast("int").alias("d")).where("d <> 0")
    types = dict(targets.dtypes)
    empty = [F.lit(None).cast(types[c]).alias(c) for c in EVENT_COLUMNS]
    rows = union_by(
        "customer_id",
        merged.select("customer_id", "vts", "ord", "kind", "d", *empty),
        targets.select("customer_id", "vts", "ord", F.lit(99).alias("kind"), F.lit(0).alias("d"), *EVENT_COLUMNS),
    )
    scanned = running(
        rows,
        "customer_id",
        ["vts", "ord", "kind"],
        sums={n: F.when(F.col("kind") == k, F.col("d")).otherwise(0) for n, k in KIND.items()},
        load=load,
        stage=stage,
        name="cluster_steps",
        **scan,
    )
    return scanned.where(F.col("event_id").isNotNull()).drop("kind", "d")


def raw_features(counters: DataFrame, reads: DataFrame) -> DataFrame:
    """Raw features; ``reads`` is (event_id, max_fanout, top_devices), with customer_id where kept by customer."""
    lo, hi = C.AMOUNT_BAND_PAISE
    hit = F.col("amount_paise").between(lo, hi).cast("double")
    mean_hit = (F.col("n_off_band") == 0).cast("double")
    ratio = F.when(F.col("n_device") > 0, half_even(F.col("n_customer") / F.col("n_device"), 3)).otherwise(0.0)
    taint = F.coalesce(*[F.when(F.col(f"n_taint_{h}") > 0, F.lit(v)) for h, v in enumerate(C.TAINT_BY_HOP)], F.lit(0.0))
    return counters.join(reads, [c for c in ("customer_id", "event_id") if c in reads.columns], "left").select(
        *EVENT_COLUMNS,
        "customer_id",
        "vts",
        "ord",
        "top_devices",
        *[F.col(c).cast("long").alias(c) for c in COUNTERS[:6]],
        ratio.alias("device_identity_ratio"),
        F.coalesce("max_fanout", F.lit(0)).cast("long").alias("cross_merchant_fanout"),
        taint.alias("taint"),
        F.col("n_active_merchants").cast("long").alias("velocity_merchants_72h"),
        (F.col("n_burn_rotate") > 0).cast("long").alias("burn_rotate"),
        ((hit + mean_hit) / 2).alias("amount_band_hit"),
        half_even(F.col("n_fresh") / F.col("n_customer"), 6).alias("new_identity_fraction"),
    )


def normalize_features(raw: DataFrame) -> DataFrame:
    """Add n_f1..n_f7 in [0, 1] from the raw columns."""
    scaled = (
        half_even(clip01(F.col("device_identity_ratio") / 6.0), 6),
        half_even(clip01((F.col("cross_merchant_fanout") - 2) / 4.0), 6),
        half_even(clip01(F.col("taint")), 6),
        half_even(clip01(F.col("velocity_merchants_72h") / 5.0), 6),
        F.col("burn_rotate").cast("double"),
        F.col("amount_band_hit"),
        half_even(clip01(F.col("new_identity_fraction")), 6),
    )
    return raw.select("*", *[c.alias(f"n_f{i}") for i, c in enumerate(scaled, start=1)])
