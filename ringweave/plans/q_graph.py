"""Queries: graph build, clusters, lookups, online features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.functions.normalize import node_value
from ringweave.operators import cluster as CL
from ringweave.operators import features as FE
from ringweave.operators import graph as G
from ringweave.operators import lookups as LK
from ringweave.operators import snapshots as SN
from ringweave.operators import taint as T
from ringweave.plans import ctes as X
from ringweave.plans.q_ingest import K, NF
from ringweave.plans.registry import query
from ringweave.session import stage


def sec(column: str):
    """Whole seconds of a microsecond column, under the plain name."""
    return F.floor(F.col(column) / C.SECOND).alias(column.removesuffix("_us"))


# --- graph build -------------------------------------------------------------
@query("build_links", "select c customer_id, node, first_seen, last_seen, event_count from lnk")
def _(ws):
    return ws.graph.links.select("customer_id", "node", sec("first_seen_us"), sec("last_seen_us"), "event_count")


@query("build_nodes", X.NODE_SQL)
def _(ws):
    return ws.nodes.select(
        "node", "ntype", sec("first_seen_us"), sec("last_seen_us"), "event_count", "amount_sum", "confirmed_fraud",
        "merchant_count", "linked_identity_count", "fraud_taint",
    )


@query("confirmed_fraud", "select customer_id, min(ts) fraud_ts, count(*) outcomes from ev where fraud group by 1")
def _(ws):
    outcomes = ws.graph.timeline.where("fraud_outcome").groupBy("customer_id").agg(F.count("*").alias("outcomes"))
    return ws.graph.customers.where("fraud_us is not null").select("customer_id", F.floor(F.col("fraud_us") / C.SECOND).alias("fraud_ts")).join(
        outcomes, "customer_id"
    )


@query("entity_degree", "select node, count(distinct c) linked_identity_count from elnk group by 1")
def _(ws):
    return ws.graph.entities.where("ntype <> 'merchant'").select("node", F.col("n_customers").alias("linked_identity_count"))


@query(
    "entity_merchant_fanout",
    "select a.node, count(distinct b.node) merchant_count from elnk a join lnk b on b.c = a.c and b.ntype = 'merchant' group by 1",
)
def _(ws):
    return SN.current_counts(ws.graph.links).select("node", "merchant_count")


@query("entity_snapshot_history", "select node, event_id, merchant_count, linked_identity_count from snap")
def _(ws):
    return ws.graph.snapshots.select("node", "event_id", "merchant_count", "linked_identity_count")


@query("taint_levels", "select node, fraud_taint from tlevel")
def _(ws):
    return T.taint_levels(ws.graph.links, ws.graph.customers)


@query("graph_size", "select ntype, count(*) nodes from (select distinct ntype, node from lnk union all select distinct 'customer', customer_id from ev) group by 1")
def _(ws):
    return LK.graph_size(ws.nodes)


@query(
    "replay_graph",
    """select ntype, count(*) nodes, cast(sum(merchant_count) as bigint) merchant_counts, cast(sum(linked_identity_count) as bigint) identity_counts,
         round_even(sum(fraud_taint), 4) taint from (""" + X.NODE_SQL + ") group by 1",
)
def _(ws):
    shuffled = G.LinkGraph(ws.payments.orderBy(F.xxhash64("event_id")))
    taint = T.taint_levels(shuffled.links, shuffled.customers)
    nodes = LK.build_nodes(shuffled.customers, shuffled.entities, taint, LK.last_snapshots(shuffled.snapshots))
    return nodes.groupBy("ntype").agg(
        F.count("*").alias("nodes"), F.sum("merchant_count").alias("merchant_counts"),
        F.sum("linked_identity_count").alias("identity_counts"), F.bround(F.sum("fraud_taint"), 4).alias("taint"),
    )


# --- clusters and lookups ------------------------------------------------------
@query("cluster_members", "select c customer_id, ntype, node, count(*) over (partition by c) > 200 truncated from fnode")
def _(ws):
    return LK.flagged(LK.final_members(ws.graph.members), ws.graph.crowded)


@query("cluster_members_capped", "select c customer_id, least(count(*), 8) size, count(*) > 8 truncated from fnode group by 1")
def _(ws):
    """A cap that most clusters outgrow."""
    members, crowded = CL.cluster_memberships(ws.graph.links, stage, 8)
    return LK.flagged(LK.final_members(members).groupBy("customer_id").agg(F.count("*").alias("size")), crowded)


@query(
    "events_truncated_capped",
    """select e.event_id, any_value(f.customers) + count(distinct n.node) > 8 truncated
       from ev e join cnode n using (event_id) join f1 f using (event_id) group by 1""",
)
def _(ws):
    """The flag as of each event, at a cap that most clusters outgrow."""
    _, crowded = CL.cluster_memberships(ws.graph.links, stage, 8)
    return LK.flagged(ws.graph.timeline.select("event_id", "customer_id", "ord"), crowded, F.col("ord")).select("event_id", "truncated")


@query(
    "cluster_members_r",
    """select customer_id, cap, radius, least(cap, n) size, n > cap truncated from (
         select c customer_id, 1::bigint radius, 1 + count(distinct node) n from lnk group by 1
         union all select c, 2, count(*) from (select c, node from lnk union select c, 'customer:' || c2 from fcl) group by 1
         union all select c, 3, count(*) from fnode group by 1
         union all select c, 4, count(*) from h4 group by 1), (select unnest([200, 8])::bigint as cap)""",
    {"h4": "select c, node from fnode union select distinct f.c, 'customer:' || b.c from fnode f join elnk b on b.node = f.node"},
)
def _(ws):
    """With the cap of the product and one that most clusters outgrow."""

    def sizes(cap: int):
        widest = LK.cluster_members_r(ws.graph.links, 4, stage, cap)
        counted = widest.groupBy("customer_id").agg(*[F.count_if(F.col("hop") <= r).alias(f"r{r}") for r in range(1, 5)], F.min("over_at").alias("over_at"))
        over = [F.coalesce(F.col("over_at") <= r, F.lit(False)).alias("truncated") for r in range(1, 5)]
        rows = F.array(*[F.struct(F.lit(r).cast("long").alias("radius"), F.col(f"r{r}").alias("size"), over[r - 1]) for r in range(1, 5)])
        return counted.select("customer_id", F.lit(cap).cast("long").alias("cap"), F.inline(rows).alias("radius", "size", "truncated"))

    return sizes(C.CLUSTER_CAP).unionByName(sizes(8))


CLUSTER_STATS_SQL = """
  select c customer_id, customers, devices, vpas, phones, emails, merchants,
    case when devices > 0 then round_even(customers / devices, 3) else 0.0 end device_identity_ratio, fanout max_cross_merchant_fanout, truncated from (
    select f.c, count(*) > 200 truncated, count(*) filter (f.ntype = 'customer') customers, count(*) filter (f.ntype = 'device') devices, count(*) filter (f.ntype = 'upi') vpas,
      count(*) filter (f.ntype = 'phone') phones, count(*) filter (f.ntype = 'email') emails, count(*) filter (f.ntype = 'merchant') merchants,
      coalesce(max(s.merchant_count) filter (f.ntype in ('upi', 'phone', 'device')), 0) fanout
    from fnode f left join snaplast s on s.node = f.node group by 1)
"""


@query("cluster_stats", CLUSTER_STATS_SQL)
def _(ws):
    return LK.cluster_stats(ws.graph.members, LK.last_snapshots(ws.graph.snapshots), ws.graph.crowded)


@query("cluster_stats_current", CLUSTER_STATS_SQL.replace("snaplast s", "curr s"),
       {"curr": "select a.node, count(distinct b.node) merchant_count from elnk a join lnk b on b.c = a.c and b.ntype = 'merchant' group by 1"})
def _(ws):
    return LK.cluster_stats(ws.graph.members, SN.current_counts(ws.graph.links), ws.graph.crowded)


@query("cluster_customers", "select distinct c customer_id, c2 member_id from fcl")
def _(ws):
    people = ws.graph.members.where(F.col("out_ord") == C.FOREVER)
    return FE.cluster_customers(people).select("customer_id", "member_id")


MASKED = r"""case when {0} like 'phone:%' then '+' || substr(regexp_replace({0}, '\D', '', 'g'), 1, 4) || 'XXXX' || right({0}, 4)
  else substr({0}, strpos({0}, ':') + 1) end"""


@query(
    "cluster_view",
    f"""select *, count(*) filter (part = 'node') over (partition by customer_id) > 200 truncated from (
        select f.c customer_id, 'node' part, f.ntype kind, {MASKED.format('f.node')} id, null::varchar target, coalesce(t.fraud_taint, 0.0)::double taint
        from fnode f left join tlevel t on t.node = f.node
        union all select f.c, 'edge', l.ntype, f.c2, {MASKED.format('l.node')}, null from fcl f join lnk l on l.c = f.c2)
        where customer_id in (select customer_id from ev where prior_outcome is not null)""",
)
def _(ws):
    """The clusters an analyst opens: those of customers with an outcome."""
    wanted = ws.payments.where("prior_outcome is not null").select("customer_id")
    return LK.cluster_view(wanted, ws.graph.members, ws.graph.links, ws.taint, ws.graph.crowded)


@query(
    "taint_path",
    """select event_id, coalesce(path, '') taint_path from ev left join (
         select e.event_id, e.customer_id || '>' || substr(p.node, strpos(p.node, ':') + 1) || '>' || p.f path from ev e join paths p on p.c = e.customer_id and p.v <= e.rn
         qualify row_number() over (partition by e.event_id order by p.v, p.w, p.f, p.node) = 1) using (event_id)""",
    {"paths": """select a.c, a.node, b.c f, greatest(a.fl, b.fl, f.fs) v, greatest(b.fl, f.fs) w from elnk a join elnk b on b.node = a.node and b.c <> a.c
                 join fraudster f on f.c = b.c"""},
)
def _(ws):
    return ws.verdicts.select("event_id", F.concat_ws(">", "taint_path").alias("taint_path"))


@query(
    "neighbors",
    """select 'customer:' || c node, node neighbour from lnk where c in (select customer_id from ev where fraud)
       union all select node, 'customer:' || c from lnk where ntype = 'device' and node in (select node from touch join ev using (event_id) where fraud)""",
)
def _(ws):
    frauds = ws.graph.timeline.where("fraud_outcome")
    wanted = frauds.select(F.concat(F.lit("customer:"), "customer_id").alias("node")).unionByName(
        frauds.where("device is not null").select(F.col("device").alias("node"))
    )
    return LK.neighbors(ws.graph.links, wanted)


@query("successors", "select 'customer:' || c node, node successor from lnk where c in (select customer_id from ev where fraud)")
def _(ws):
    wanted = ws.graph.timeline.where("fraud_outcome").select(F.concat(F.lit("customer:"), "customer_id").alias("node"))
    return LK.successors(ws.graph.links, wanted)


@query(
    "edge_lookup",
    """select w.c customer_id, w.node, l.first_seen, l.last_seen, l.event_count from (
         select distinct customer_id c, 'device:dev_' || cast(substr(customer_id, 6) as bigint) node from ev) w left join lnk l on l.c = w.c and l.node = w.node""",
)
def _(ws):
    own = F.concat(F.lit("device:dev_"), F.expr("substring(customer_id, 6)").cast("bigint").cast("string"))
    pairs = ws.payments.select("customer_id", own.alias("node")).distinct()
    return LK.edge_lookup(ws.graph.links, pairs).select("customer_id", "node", sec("first_seen_us"), sec("last_seen_us"), "event_count")


@query(
    "node_lookup",
    """select w.node, n.node is not null found, n.amount_sum from (select distinct 'customer:' || case when k % 9 = 0 then 'x' else '' end || customer_id node from ev) w
       left join (select 'customer:' || customer_id node, cast(sum(amount_paise) as bigint) amount_sum from ev group by 1) n using (node)""",
)
def _(ws):
    odd = F.when(K() % 9 == 0, "x").otherwise("")
    wanted = ws.payments.select(F.concat(F.lit("customer:"), odd, "customer_id").alias("node")).distinct()
    return LK.node_lookup(ws.nodes, wanted).select("node", "found", "amount_sum")


def risk_requests(ws):
    kinds = F.element_at(F.array(*[F.lit(t) for t in ("upi", "phone", "device", "email", "ip")]), (K() % 5 + 1).cast("int"))
    value = F.when(K() % 5 == 0, F.col("upi")).when(K() % 5 == 1, F.col("phone")).when(K() % 5 == 2, F.col("device")).when(K() % 5 == 3, F.col("email"))
    return ws.graph.timeline.select(
        kinds.alias("entity_type"),
        F.coalesce(F.when(K() % 13 == 0, F.lit("nobody")), node_value(value), F.lit("none")).alias("entity_value"),
    ).distinct()


REQ = {
    "req": """select distinct case k % 5 when 0 then 'upi' when 1 then 'phone' when 2 then 'device' when 3 then 'email' else 'ip' end entity_type,
       coalesce(case when k % 13 = 0 then 'nobody' end, case k % 5 when 0 then upi_entity when 1 then phone_entity when 2 then device_entity
         when 3 then email_entity end, 'none') entity_value from ev""",
}


@query(
    "entity_risk",
    """select entity_type, entity_value, case when entity_type = 'ip' then 'bad_entity_type' when s.node is null then 'not_found' else 'ok' end status,
         s.merchant_count, s.linked_identity_count, case when s.node is not null then coalesce(t.fraud_taint, 0.0)::double end fraud_taint, l.last_seen last_seen_epoch
       from req left join snaplast s on s.node = entity_type || ':' || entity_value left join tlevel t on t.node = s.node
       left join (select node, max(last_seen) last_seen from lnk group by 1) l on l.node = s.node""",
    REQ,
)
def _(ws):
    return LK.entity_risk(risk_requests(ws), ws.nodes)


@query(
    "entity_risk_full",
    """select entity_type, entity_value, case when entity_type = 'ip' then 'bad_entity_type' when n.node is null then 'not_found' else 'ok' end status,
         'customer:' || l.c linked_node, n.merchant_count, n.linked_identity_count, n.fraud_taint::double fraud_taint, n.confirmed_fraud, n.event_count, n.amount_sum,
         n.first_seen * 1000000 first_seen_us, n.last_seen * 1000000 last_seen_us
       from (select distinct * from req) r left join (""" + X.NODE_SQL + """) n on entity_type <> 'ip' and n.node = entity_type || ':' || entity_value
       left join elnk l on l.node = n.node""",
    REQ,
)
def _(ws):
    return LK.entity_risk_full(risk_requests(ws), ws.nodes, ws.graph.links)


@query(
    "evidence_bundle",
    """select e.event_id, array_to_string((list_sort(list(distinct substr(n.node, 10)) filter (n.ntype = 'merchant')))[1:8], ',') linked_merchants,
         coalesce(any_value(d.devices), '') shared_devices, any_value(f.customers) cluster_customers,
         any_value(f.customers) + count(distinct n.node) > 200 truncated
       from ev e join cnode n using (event_id) join f1 f using (event_id) left join (
         select event_id, string_agg(substr(node, 8) || '/' || linked_identity_count || '/' || merchant_count, ',' order by linked_identity_count desc, node) devices
         from (select * from snapread where ntype = 'device' qualify row_number() over (partition by event_id order by linked_identity_count desc, node) <= 3)
         group by 1) d using (event_id) group by 1""",
)
def _(ws):
    device = lambda d: F.concat_ws("/", d["device_id"], d["linked_identities"], d["merchant_count"])
    return ws.verdicts.select(
        "event_id", F.concat_ws(",", "linked_merchants").alias("linked_merchants"),
        F.concat_ws(",", F.transform("shared_devices", device)).alias("shared_devices"), "cluster_customers", "truncated",
    )


@query("identity_components", "select customer_id, component from comp")
def _(ws):
    return ws.components


# --- online features -----------------------------------------------------------
FEATURE_KEYS = (
    ("f1_device_identity_ratio", "f1", "device_identity_ratio"),
    ("f2_cross_merchant_fanout", "f2", "cross_merchant_fanout"),
    ("f3_taint", "f3", "taint"),
    ("f4_velocity_72h", "f4", "velocity_merchants_72h"),
    ("f5_burn_rotate", "f5", "burn_rotate"),
    ("f6_amount_pattern", "f6", "amount_band_hit"),
    ("f7_new_identity_fraction", "f7", "new_identity_fraction"),
)


def _feature(key: str, cte: str, column: str) -> None:
    @query(key, f"select event_id, v {column} from {cte}")
    def _(ws):
        return ws.graph.features.select("event_id", column)


for _spec in FEATURE_KEYS:
    _feature(*_spec)

RAW = ", ".join(C.RAW_FEATURES)


# as of each event: more nodes in its cluster than the cap
CUT = {"cutev": """select e.event_id, any_value(f.customers) + count(distinct n.node) > 200 truncated
    from ev e join cnode n using (event_id) join f1 f using (event_id) group by 1"""}  # fmt: skip


@query("extract_features", f"select event_id, {RAW}, {NF}, truncated from feat join cutev using (event_id)", CUT)
def _(ws):
    return ws.graph.features.select("event_id", *C.RAW_FEATURES, *[f"n_f{i}" for i in range(1, 8)], "truncated")


@query("score_events", f"select event_id, customer_id, merchant_id, {RAW}, score, verdict, reason_codes, truncated from scored join cutev using (event_id)", CUT)
def _(ws):
    return ws.verdicts.select(
        "event_id", "customer_id", "merchant_id", *C.RAW_FEATURES, "score", "verdict", F.concat_ws(",", "reason_codes").alias("reason_codes"), "truncated"
    )


@query(
    "score_overlay",
    f"select event_id, {RAW}, score, verdict, truncated from scored join cutev using (event_id) where cast(substr(event_id, 5) as bigint) % 7 = 0",
    {**CUT, "ev": X.CTES["ev"].replace("order by ts", "order by (k % 7 = 0), ts")},
)
def _(ws):
    history, overlay = ws.payments.where(K() % 7 != 0), ws.payments.where(K() % 7 == 0)
    return G.score_overlay(history, overlay).scores().select("event_id", *C.RAW_FEATURES, "score", "verdict", "truncated")
