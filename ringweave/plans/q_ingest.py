"""Queries: sources, sinks, ingest tables, row-level functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.functions import narrative as N
from ringweave.functions import normalize as NZ
from ringweave.functions.scoring import weight_problems
from ringweave.operators import graph as G
from ringweave.operators import links as L
from ringweave.operators import ops_metrics as O
from ringweave.operators import reports as R
from ringweave.operators import splits as SP
from ringweave.operators.features import normalize_features
from ringweave.plans import ctes as X
from ringweave.plans.registry import query
from ringweave.plans.workspace import Workspace
from ringweave.sources import store

def K():
    """Order number inside an event id."""
    return F.expr("substring(event_id, 5)").cast("bigint")


def epoch_seconds():
    return F.unix_seconds("ts")


# --- feeds derived from the payments -----------------------------------------
def raw_feed(ws: Workspace) -> DataFrame:
    """Payments with some rows spoiled, for ingest validation."""
    return ws.payments.select(
        "event_id",
        F.when(K() % 61 == 0, F.lit(None)).otherwise(F.col("merchant_id")).alias("merchant_id"),
        F.when(K() % 59 == 0, F.lit(None)).otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(K() % 37 == 0, -F.col("amount_paise")).otherwise(F.col("amount_paise")).alias("amount_paise"),
        "currency", "upi_vpa", "phone", "device_id", "email", "ip", "ts",
        F.when(K() % 43 == 0, "cash").otherwise(F.col("payment_method")).alias("payment_method"),
        F.when(K() % 47 == 0, "lost").otherwise(F.col("prior_outcome")).alias("prior_outcome"),
    )


SPOILED = """
  select event_id, ts, case when k % 61 = 0 then null else merchant_id end merchant_id,
    case when k % 59 = 0 then null else customer_id end customer_id,
    case when k % 37 = 0 then -amount_paise else amount_paise end amount_paise,
    case when k % 43 = 0 then 'cash' else payment_method end payment_method,
    case when k % 47 = 0 then 'lost' else prior_outcome end prior_outcome from pay
"""


def copied_feed(ws: Workspace) -> DataFrame:
    """Payments plus copies of some, later or at the same time, with an arrival time."""
    base = ws.payments.withColumn("arrival", epoch_seconds())
    copies = base.where(K() % 10 == 0).withColumn("arrival", F.col("arrival") + 60).withColumn("amount_paise", F.col("amount_paise") + 1)
    return base.unionByName(copies).unionByName(base.where(K() % 10 == 3))


def stored_events(ws: Workspace) -> DataFrame:
    return ws.payments.where(K() % 5 == 0)


FEED = """
  select *, ts arrival from pay
  union all select * replace (amount_paise + 1 as amount_paise), ts + 60 arrival from pay where k % 10 = 0
  union all select *, ts arrival from pay where k % 10 = 3
"""
FEEDX = {"feed": FEED}


@query(
    "read_events_jsonl",
    """select case when k % 50 > 1 then event_id end event_id, case when k % 50 > 0 then customer_id end customer_id, case when k % 50 > 0 then amount_paise end amount_paise,
         case when k % 50 > 0 then upi_vpa end upi_vpa, case when k % 50 > 0 then phone end phone, case when k % 50 > 0 then ts end ts_epoch,
         case when k % 50 > 0 then prior_outcome end prior_outcome,
         case k % 50 when 0 then 'malformed' when 1 then 'missing_event_id' when 2 then 'unknown_field:is_fraud' else '' end errors from pay""",
)
def _(ws):
    """Every fiftieth line each is cut off, lacks its id or has a field too many; blank lines lie between."""
    path, fields = ws.folder("events-jsonl"), ws.payments.columns
    whole, no_id = F.to_json(F.struct(*fields)), F.to_json(F.struct(*[c for c in fields if c != "event_id"]))
    more = F.to_json(F.struct(*fields, F.lit(True).alias("is_fraud")))
    line = F.when(K() % 50 == 0, F.expr("left(whole, length(whole) - 5)")).when(K() % 50 == 1, no_id).when(K() % 50 == 2, more).otherwise(F.col("whole"))
    lines = ws.payments.withColumn("whole", whole).select(F.when(K() % 9 == 0, F.concat(F.lit("\n  \n"), line)).otherwise(line).alias("value"))
    lines.write.mode("overwrite").text(path)
    events = store.read_events_jsonl(ws.spark, path)
    return events.select(
        "event_id", "customer_id", "amount_paise", "upi_vpa", "phone", epoch_seconds().alias("ts_epoch"), "prior_outcome",
        F.concat_ws(",", "errors").alias("errors"),
    )


def _digest_sql(columns: dict[str, str]) -> str:
    """Digest of all rows: the sums of four 64-bit parts."""
    parts = ", ".join(f"'{c}', {columns[c]}" for c in sorted(columns))
    row = f"sha256(json_object({parts})::varchar)"
    return " || '-' || ".join(f"coalesce(cast(sum(cast('0x' || substr({row}, {1 + 16 * i}, 16) as ubigint)) as varchar), '0')" for i in range(4))


EVENT_COLUMNS = {c: c for c in ("event_id", "merchant_id", "customer_id", "amount_paise", "upi_vpa", "phone", "device_id", "email", "ip", "payment_method", "prior_outcome")} | {
    "ts": "strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S')"
}
LABEL_COLUMNS = {c: c for c in ("event_id", "is_fraud", "ring_id", "ring_strategy")}


@query(
    "write_event_label_artifacts",
    f"""select 'events' artifact, count(*) n_rows, {_digest_sql(EVENT_COLUMNS)} digest from pay
        union all select 'labels', count(*), {_digest_sql(LABEL_COLUMNS)} from lab""",
)
def _(ws):
    return store.write_event_label_artifacts(store.event_row(ws.payments), ws.labels, ws.folder("artifacts"))


@query(
    "validate_events",
    """select event_id, concat_ws(',', case when merchant_id is null then 'missing_merchant_id' end,
          case when customer_id is null then 'missing_customer_id' end, case when amount_paise < 0 then 'negative_amount' end,
          case when payment_method not in ('upi', 'card', 'netbanking') then 'bad_payment_method' end,
          case when prior_outcome not in ('chargeback', 'refund_abuse', 'confirmed_fraud') then 'bad_prior_outcome' end) errors from spoiled""",
    {"spoiled": SPOILED},
)
def _(ws):
    return store.validate_events(raw_feed(ws)).select("event_id", F.concat_ws(",", "errors").alias("errors"))


@query(
    "dedupe_ingest",
    """select event_id, arg_min(amount_paise, arrival) amount_paise, min(arrival) arrival from feed
       where event_id not in (select event_id from pay where k % 5 = 0) group by 1""",
    FEEDX,
)
def _(ws):
    return store.dedupe_ingest(copied_feed(ws), stored_events(ws)).select("event_id", "amount_paise", "arrival")


@query(
    "ingest_batch_status",
    """select status, count(*) items, count(prior) with_prior_verdict, cast(coalesce(sum(prior), 0) as bigint) prior_score_sum from (
         select f.event_id, f.status, case when f.status = 'duplicate' then s.score end prior
         from (select *, case when k % 17 = 0 then 'spooled' when k % 5 <> 0 and row_number() over (partition by event_id order by arrival) = 1
                 then 'accepted' else 'duplicate' end status from feed) f
         left join scored s on s.event_id = f.event_id and f.k % 5 = 0) group by 1""",
    FEEDX,
)
def _(ws):
    verdicts = ws.scored.join(stored_events(ws).select("event_id"), "event_id", "left_semi")
    feed = copied_feed(ws).withColumn("spooled", K() % 17 == 0)
    items = store.ingest_batch_status(feed, stored_events(ws), verdicts, spooled="spooled")
    return items.groupBy("status").agg(
        F.count(F.lit(1)).alias("items"),
        F.count("prior_verdict").alias("with_prior_verdict"),
        F.coalesce(F.sum("prior_score"), F.lit(0)).alias("prior_score_sum"),
    )


@query("append_verdicts", "select verdict, count(*) appended, cast(sum(score) as bigint) score_sum from scored join pay using (event_id) where k % 3 <> 0 group by 1")
def _(ws):
    existing = ws.log.where(K() % 3 == 0)
    new = store.append_verdicts(ws.log.unionByName(ws.log.where(K() % 4 == 0)), existing)
    path = ws.folder("verdict-log")
    existing.write.mode("overwrite").parquet(path)
    new.write.mode("append").parquet(path)
    table = ws.spark.read.parquet(path)
    added = table.join(existing.select("event_id"), "event_id", "left_anti")
    return added.groupBy("verdict").agg(F.count(F.lit(1)).alias("appended"), F.sum("score").alias("score_sum"))


def feedback_feed(ws: Workspace) -> DataFrame:
    decision = F.when(K() % 7 == 0, "MAYBE").when(K() % 3 == 0, "CLEAR").when(K() % 3 == 1, "CONFIRM_FRAUD").otherwise("UNKNOWN")
    return ws.payments.select(
        F.when(K() % 11 == 0, F.concat(F.lit("gone-"), "event_id")).otherwise(store.verdict_id(F.col("event_id"))).alias("verdict_id"),
        decision.alias("analyst_decision"),
        F.lit(None).cast("string").alias("note"),
    )


@query(
    "append_feedback",
    """select case when k % 11 = 0 then 'unknown_verdict' when k % 7 = 0 then 'bad_decision' else 'recorded' end status,
         case when k % 7 = 0 then 'MAYBE' when k % 3 = 0 then 'CLEAR' when k % 3 = 1 then 'CONFIRM_FRAUD' else 'UNKNOWN' end analyst_decision,
         count(*) items from pay group by 1, 2""",
)
def _(ws):
    return store.append_feedback(feedback_feed(ws), ws.log).groupBy("status", "analyst_decision").agg(F.count(F.lit(1)).alias("items"))


@query(
    "append_admin_audit",
    """select 'entity_full_lookup' action, 'device:' || device_entity entity, 'admin' scope, count(*) requests
       from norm where device_entity is not null and prior_outcome is not null group by 2""",
)
def _(ws):
    asked = ws.graph.timeline.where("device is not null and fraud_outcome")
    return store.admin_audit_rows(asked, "entity_full_lookup", F.col("device")).groupBy("action", "entity", "scope").agg(
        F.count(F.lit(1)).alias("requests")
    )


@query(
    "spool_and_replay",
    """select count(*) stored_rows, count(distinct event_id) stored_ids, cast(sum(amount_paise) as bigint) amount_sum from
       (select event_id, arg_min(amount_paise, arrival) amount_paise from feed group by 1)""",
    FEEDX,
)
def _(ws):
    feed = copied_feed(ws)
    path = ws.folder("spool")
    feed.where(K() % 6 == 0).write.mode("overwrite").json(path)
    spooled = ws.spark.read.schema(feed.schema).json(path)
    live = feed.where(K() % 6 != 0)
    stored = live.where(K() % 5 == 0)
    stored = store.first_arrivals(stored)
    once = stored.unionByName(store.spool_and_replay(spooled, live, stored))
    twice = once.unionByName(store.spool_and_replay(spooled, live, once))
    return twice.agg(
        F.count(F.lit(1)).alias("stored_rows"), F.count_distinct("event_id").alias("stored_ids"), F.sum("amount_paise").alias("amount_sum")
    )


@query("graph_snapshot", "select ntype, count(distinct node) nodes, count(*) links, cast(sum(event_count) as bigint) uses from lnk group by 1")
def _(ws):
    folder = ws.folder("graph")
    store.save_graph(ws.nodes, ws.graph.links, folder)
    nodes, links = store.load_graph(ws.spark, folder)
    return links.join(nodes.select("node"), "node").groupBy("ntype").agg(
        F.count_distinct("node").alias("nodes"), F.count(F.lit(1)).alias("links"), F.sum("event_count").alias("uses")
    )


NODE_COLUMNS = {c: c for c in ("node", "ntype", "event_count", "amount_sum", "confirmed_fraud", "merchant_count", "linked_identity_count", "fraud_us")} | {
    "first_seen_us": "first_seen * 1000000",
    "last_seen_us": "last_seen * 1000000",
    "amount_count": "event_count",
    "taint_percent": "cast(round(fraud_taint * 100) as bigint)",
}


@query(
    "graph_fingerprint",
    f"""select 'links' artifact, count(*) n_rows, {_digest_sql({'customer_id': 'c', 'node': 'node', 'ntype': 'ntype', 'first_seen_us': 'first_seen * 1000000', 'last_seen_us': 'last_seen * 1000000', 'event_count': 'event_count'})} digest from lnk
        union all select 'nodes', count(*), {_digest_sql(NODE_COLUMNS)} from (
          select n.*, coalesce(f.fraud_us, 0) fraud_us from ({X.NODE_SQL}) n
          left join (select 'customer:' || customer_id node, min(ts) * 1000000 fraud_us from ev where fraud group by 1) f using (node))""",
)
def _(ws):
    """All nodes, customers included, and links with all their attributes."""
    links = ws.graph.links.select("customer_id", "node", "ntype", "event_count", "first_seen_us", "last_seen_us")
    nodes = ws.nodes.withColumn("taint_percent", F.round(F.col("fraud_taint") * 100).cast("long"))
    nodes = nodes.withColumn("amount_count", F.col("event_count")).select(*NODE_COLUMNS)
    return store.fingerprint(links, "links").unionByName(store.fingerprint(nodes, "nodes"))


@query(
    "load_model_config",
    f"""select verdict, count(*) events, cast(sum(score) as bigint) score_sum from (select *, {X.band_sql('score', 42, 49)} verdict from
        (select {X.SCORE} score from (select {X.contributions_sql((13, 5, 20, 12, 8, 7, 35))} from feat))) group by 1""",
)
def _(ws):
    path = ws.folder("model-config")
    locked = {"model_version": C.CALIBRATED_MODEL_VERSION, "seed": 42, "weights": C.CALIBRATED_WEIGHTS, "thresholds": C.CALIBRATED_THRESHOLDS}
    store.save_model_config(ws.spark, locked, path)
    config = store.load_model_config(ws.spark, path, required=True)
    scored = G.score_frame(ws.graph.features, config["weights"], config["thresholds"])
    return scored.groupBy("verdict").agg(F.count(F.lit(1)).alias("events"), F.sum("score").alias("score_sum"))


@query(
    "serving_label_separation_check",
    """select 'label_columns_in_events' rule, 0::bigint violations
       union all select 'events_without_label', count(*) from pay where event_id not in (select event_id from lab)
       union all select 'labels_without_event', count(*) from lab where event_id not in (select event_id from pay)""",
)
def _(ws):
    return store.serving_label_separation(ws.payments, ws.labels)


@query("migrate_schema_add_column", "select k % 2 = 1 is_old, count(*) verdicts, count(case when k % 2 = 0 then 1 end) with_challenger from pay group by 1")
def _(ws):
    path = ws.folder("migrated-log")
    old = ws.log.where(K() % 2 == 1).drop("challenger")
    new = ws.log.where(K() % 2 == 0).withColumn("challenger", F.lit("{}"))
    old.write.mode("overwrite").parquet(path)
    new.write.mode("append").parquet(path)
    table = ws.spark.read.option("mergeSchema", "true").parquet(path)
    return store.migrate_schema_add_column(table).groupBy((K() % 2 == 1).alias("is_old")).agg(
        F.count(F.lit(1)).alias("verdicts"), F.count("challenger").alias("with_challenger")
    )


# --- normalizers and scalar functions -------------------------------------------
def _normalizer(name, column, fn, sql):
    @query(name, f"select event_id, {column} raw, {sql(column)} normalized from pay")
    def _(ws):
        return ws.payments.select("event_id", F.col(column).alias("raw"), fn(F.col(column)).alias("normalized"))


_normalizer("normalize_phone", "phone", NZ.normalize_phone, X.phone_sql)
_normalizer("normalize_vpa", "upi_vpa", NZ.normalize_vpa, X.vpa_sql)
_normalizer("normalize_device", "device_id", NZ.normalize_device, X.device_sql)
_normalizer("normalize_email", "email", NZ.normalize_email, X.email_sql)
_normalizer("normalize_ip", "ip", NZ.normalize_ip, X.ip_sql)


@query(
    "normalize_event_entities",
    """select event_id, upi_entity, phone_entity, device_entity, email_entity, ip_entity,
         case when phone_entity is null then phone end unnormalized_phone from norm""",
)
def _(ws):
    return L.normalize_event_entities(ws.payments).select(
        "event_id", *[f"{k}_entity" for k in (*C.ENTITY_TYPES, "ip")], "unnormalized_phone"
    )


@query("graph_entities", "select event_id, customer_id, upi_entity, phone_entity, device_entity, email_entity from norm")
def _(ws):
    return L.graph_entities(ws.payments)


@query("explode_entities", "select event_id, c customer_id, ntype, node from touch")
def _(ws):
    return L.explode_entities(ws.graph.timeline).select("event_id", "customer_id", "ntype", "node")


@query(
    "typed_node_id",
    """select distinct node, ntype kind, substr(node, length(ntype) + 2) val from touch
       union all select distinct 'customer:' || customer_id, 'customer', customer_id from ev""",
)
def _(ws):
    """All six node types."""
    touched = L.explode_entities(ws.graph.timeline).select("node")
    people = ws.graph.timeline.select(F.concat(F.lit("customer:"), "customer_id").alias("node"))
    nodes = touched.unionByName(people).distinct()
    return nodes.select("node", NZ.node_type(F.col("node")).alias("kind"), NZ.node_value(F.col("node")).alias("val"))


@query("identity_keys", "select event_id, c customer_id, key from ikeys")
def _(ws):
    return SP.identity_keys(ws.payments)


@query(
    "mask_phone",
    r"""select event_id, case when length(regexp_replace(phone, '\D', '', 'g')) < 8 then repeat('X', length(phone))
          else '+' || substr(regexp_replace(phone, '\D', '', 'g'), 1, 4) || 'XXXX' || right(regexp_replace(phone, '\D', '', 'g'), 4) end masked from pay""",
)
def _(ws):
    return ws.payments.select("event_id", NZ.mask_phone(F.col("phone")).alias("masked"))


@query("event_row", "select event_id, merchant_id, customer_id, amount_paise, payment_method, prior_outcome, strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%S') ts from pay")
def _(ws):
    return store.event_row(ws.payments).select("event_id", "merchant_id", "customer_id", "amount_paise", "payment_method", "prior_outcome", "ts")


NF = ", ".join(f"n_f{i}" for i in range(1, 8))


@query("normalize_features", f"select event_id, {NF} from feat")
def _(ws):
    raw = ws.graph.features.drop(*[f"n_f{i}" for i in range(1, 8)])
    return normalize_features(raw).select("event_id", *[f"n_f{i}" for i in range(1, 8)])


@query("feature_roundtrip", "select count(*) events, 0::bigint changed from feat")
def _(ws):
    stored = ws.log.select("event_id", *[F.col("features")[c].alias(c) for c in C.RAW_FEATURES], "features")
    again = normalize_features(stored)
    changed = F.lit(False)
    for i in range(1, 8):
        changed = changed | (F.col(f"n_f{i}") != F.col("features")[f"n_f{i}"])
    return again.agg(F.count(F.lit(1)).alias("events"), F.count_if(changed).alias("changed"))


CN = ", ".join(f"c_{n}" for n in C.FEATURE_NAMES)


@query("score_features", f"select event_id, {CN}, score from scored")
def _(ws):
    return ws.scored.select("event_id", *[f"c_{n}" for n in C.FEATURE_NAMES], "score")


@query(
    "validate_weights",
    f"""select event_id, concat_ws(',', case when k % 7 = 0 then 'keys' end, case when k % 5 - 2 + {C.DEFAULT_WEIGHTS['taint_propagation']} - 20 * (k % 2) < 0 then 'negative' end,
         case when 100 + k % 5 - 2 - 20 * (k % 2) <> 100 then 'sum' end) problems from pay""",
)
def _(ws):
    """A set of weights for every payment: one weight moved, some with a foreign name."""
    moved = (F.lit(C.DEFAULT_WEIGHTS["taint_propagation"]) + K() % 5 - 2 - 20 * (K() % 2)).cast("long")
    name = F.when(K() % 7 == 0, "other").otherwise("taint_propagation")
    rest = [x for n, w in C.DEFAULT_WEIGHTS.items() if n != "taint_propagation" for x in (F.lit(n), F.lit(w).cast("long"))]
    weights = F.create_map(*rest, name, moved)
    return ws.payments.select("event_id", F.concat_ws(",", weight_problems(weights)).alias("problems"))


@query("reason_codes", "select event_id, reason_codes from scored")
def _(ws):
    return ws.scored.select("event_id", F.concat_ws(",", "reason_codes").alias("reason_codes"))


@query("verdict_band", "select event_id, score, verdict from scored")
def _(ws):
    return ws.scored.select("event_id", "score", "verdict")


@query(
    "degrade_verdict",
    """select p.event_id, coalesce(s.score, 0) score, coalesce(s.verdict, 'REVIEW') verdict,
         case when s.event_id is null then 'SYS_DEGRADED' else s.reason_codes end reason_codes, s.event_id is null degraded
       from pay p left join scored s on s.event_id = p.event_id and p.k % 13 <> 0""",
)
def _(ws):
    known = ws.scored.where(K() % 13 != 0)
    out = G.degrade_verdict(ws.payments, known)
    return out.select("event_id", "score", "verdict", F.concat_ws(",", "reason_codes").alias("reason_codes"), "degraded")


@query(
    "verdict_payload",
    """select 'v' || substr(sha256('verdict:' || event_id), 1, 32) verdict_ref, event_id, score, verdict, reason_codes, 'rules-v1.0' model_version,
         'PENDING' explanation_status, taint, c_burn_rotate from scored""",
)
def _(ws):
    return ws.log.select(
        F.concat(F.lit("v"), "verdict_id").alias("verdict_ref"), "event_id", "score", "verdict",
        F.concat_ws(",", "reason_codes").alias("reason_codes"), "model_version", "explanation_status",
        F.col("features")["taint"].alias("taint"), F.col("contributions")["burn_rotate"].alias("c_burn_rotate"),
    )


# --- opinions of the shadow model in the log ------------------------------------------


def fixed_opinions(ws: Workspace) -> DataFrame:
    """An opinion for four payments in five, by their order number; one in seven is said twice."""
    p = (K() % 101) / 100
    rows = ws.payments.where(K() % 5 != 0).select("event_id", (K() % 101).cast("long").alias("score"), p.alias("probability"), (p >= C.CHALLENGER_THRESHOLD).alias("flag"), K().alias("k"))
    return rows.union(rows.where(F.col("k") % 7 == 0)).drop("k")


OPINIONS = {
    "opinions": f"select event_id, k % 101 points, (k % 101) / 100 >= {C.CHALLENGER_THRESHOLD} flag from pay where k % 5 <> 0",
    "opined": "select s.event_id, s.score, s.verdict, o.points, o.flag from scored s left join opinions o on o.event_id = s.event_id",
}


@query(
    "verdict_challenger",
    """select event_id, verdict, case when points is not null then '{"score":' || points || ',"probability":' || ((points / 100)::double)::varchar
         || ',"flag":' || flag::varchar || '}' end challenger from opined""",
    OPINIONS,
)
def _(ws):
    """The log with an opinion beside each verdict that has one."""
    return store.store_opinions(ws.log, fixed_opinions(ws)).select("event_id", "verdict", "challenger")


@query(
    "stored_agreement",
    f"""select count(*) events, count(*) filter (score >= {C.DEFAULT_THRESHOLDS["block"]} and flag) both_flag,
         count(*) filter (score >= {C.DEFAULT_THRESHOLDS["block"]} and not flag) champion_only, count(*) filter (score < {C.DEFAULT_THRESHOLDS["block"]} and flag) challenger_only,
         count(*) filter (score < {C.DEFAULT_THRESHOLDS["block"]} and not flag) neither,
         round_even(count(*) filter ((score >= {C.DEFAULT_THRESHOLDS["block"]}) = flag) / count(*)::double, 4) agreement_rate from opined where points is not null""",
    OPINIONS,
)
def _(ws):
    """Champion against the opinions read back from the log."""
    log = store.store_opinions(ws.log, fixed_opinions(ws))
    return R.champion_challenger_agreement(log.select("event_id", "score"), store.stored_opinions(log), C.DEFAULT_THRESHOLDS["block"])


# --- narratives and model calls -----------------------------------------------------


def model_responses(ws: Workspace) -> DataFrame:
    """One model response per payment, in all shapes seen in practice."""
    body = F.concat(F.lit('{"summary":"event '), "event_id", F.lit('","risk_factors":["a","b"],"recommended_action":"review"}'))
    shape = K() % 7
    return ws.payments.select(
        "event_id",
        F.when(shape == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 1, body)
        .when(shape == 2, F.concat(body, F.lit("\nHope this helps!")))
        .when(shape == 3, "   ")
        .when(shape == 4, "not json at all")
        .when(shape == 5, F.concat(F.lit('{"summary":"event '), "event_id", F.lit('"}')))
        .otherwise(F.concat(F.lit("Here: "), body))
        .alias("response"),
    )


STATUS_SQL = "case when k % 7 in (0, 1) then 'parsed' when k % 7 in (2, 6) then 'rescued' else 'invalid' end"


@query("validate_narratives", f"select event_id, {STATUS_SQL} parse_status, case when {STATUS_SQL} <> 'invalid' then 'event ' || event_id end summary, case when {STATUS_SQL} <> 'invalid' then 2::bigint end factors from pay")
def _(ws):
    return N.validate_narratives(model_responses(ws)).select(
        "event_id", "parse_status", F.col("narrative.summary").alias("summary"),
        F.when(F.col("narrative").isNotNull(), F.size("narrative.risk_factors").cast("long")).alias("factors"),
    )


@query("strip_code_fences", r"select conv_id, turn, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) cleaned from conversations")
def _(ws):
    """Every turn, some fenced with or without a language, some plain."""
    shape = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    fence = F.when(shape == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```  "))).when(shape == 1, F.concat(F.lit("  ```\n"), "text", F.lit("```")))
    fenced = ws.table("conversations").withColumn("response", F.when(shape == 2, F.col("text")).otherwise(fence))
    return fenced.select("conv_id", "turn", N.strip_code_fences(F.col("response")).alias("cleaned"))


@query(
    "narrative_prompt",
    """select event_id, 'Explain this fraud verdict for a risk analyst.' || chr(10) || '{"score":' || score || ',"verdict":"' || verdict || '","reason_codes":'
         || case when reason_codes = '' then '[]' else '["' || replace(reason_codes, ',', '","') || '"]' end || ',"cluster_customers":' || f.customers
         || ',"confirmed_fraud":' || fraud || ',"amount_paise":' || amount_paise || '}' prompt
       from scored join f1 f using (event_id) join (select event_id, fraud from ev) using (event_id)""",
)
def _(ws):
    """Six fields of the evidence; devices, merchants and the path are checked with ``evidence_bundle``."""
    outcome = ws.graph.timeline.select("event_id", F.col("fraud_outcome").alias("confirmed_fraud"))
    rows = ws.verdicts.join(outcome, "event_id")
    bundle = F.struct("score", "verdict", "reason_codes", "cluster_customers", "confirmed_fraud", "amount_paise")
    return rows.select("event_id", N.narrative_prompt(bundle).alias("prompt"))


def model_calls(ws: Workspace) -> DataFrame:
    """One model call per assistant turn: tokens from the text lengths."""
    models = [*C.PRICE_PER_MTOKEN, "unlisted.model-1"]
    turns = ws.table("conversations").where("role = 'assistant'")
    pick = F.element_at(F.array(*[F.lit(m) for m in models]), (F.col("conv_id") % len(models) + 1).cast("int"))
    return turns.select(
        "conv_id", "turn", pick.alias("model_id"), (F.length("text") * 3 + 200).cast("long").alias("input_tokens"),
        F.length("text").cast("long").alias("output_tokens"), F.lit("explanation").alias("purpose"),
    )


MODELS = [*C.PRICE_PER_MTOKEN, "unlisted.model-1"]
PRICES = [*C.PRICE_PER_MTOKEN.values(), C.DEFAULT_PRICE]
CALLS = {
    "calls": "select conv_id, turn, case conv_id % 5 "
    + " ".join(f"when {i} then '{m}'" for i, m in enumerate(MODELS))
    + " end model_id, (length(text) * 3 + 200)::bigint input_tokens, length(text)::bigint output_tokens, case conv_id % 5 "
    + " ".join(f"when {i} then {p[0]}::double" for i, p in enumerate(PRICES))
    + " end pin, case conv_id % 5 "
    + " ".join(f"when {i} then {p[1]}::double" for i, p in enumerate(PRICES))
    + " end pout from conversations where role = 'assistant'",
    "costed": "select *, round_even(input_tokens / 1000000.0::double * pin + output_tokens / 1000000.0::double * pout, 6) cost_estimate_usd from calls",
}


@query("llm_cost_estimate", "select conv_id, turn, model_id, input_tokens, output_tokens, cost_estimate_usd from costed", CALLS)
def _(ws):
    return O.llm_cost_estimate(model_calls(ws)).select("conv_id", "turn", "model_id", "input_tokens", "output_tokens", "cost_estimate_usd")


@query("llm_cost_rollup", "select model_id, count(*) calls, round_even(sum(cost_estimate_usd), 4) total_estimate_usd from costed group by 1", CALLS)
def _(ws):
    return O.llm_cost_rollup(O.llm_cost_estimate(model_calls(ws)), "model_id")
