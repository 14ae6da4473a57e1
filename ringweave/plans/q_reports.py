"""Queries: evaluation reports, dataset reports, operational metrics, queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.functions import narrative as N
from ringweave.operators import calibrate as CA
from ringweave.operators import graph as G
from ringweave.operators import lookups as LK
from ringweave.operators import ops_metrics as O
from ringweave.operators import queue as Q
from ringweave.operators import reports as R
from ringweave.operators.asof import asof_edge_last_use, first_nodes
from ringweave.operators.scan import global_index
from ringweave.plans import ctes as X
from ringweave.plans.q_models import LOCK
from ringweave.plans.q_ingest import FEEDX, K, copied_feed, model_responses
from ringweave.plans.registry import query
from ringweave.session import stage
from ringweave.sources import store

D = C.DEFAULT_THRESHOLDS

CNT = """
  select count(*) filter (score >= 70 and is_fraud) tp, count(*) filter (score >= 70 and not is_fraud) fp,
    count(*) filter (score < 70 and is_fraud) fn, count(*) filter (score between 35 and 69 and is_fraud) review_fraud,
    count(*) filter (score between 35 and 69 and not is_fraud) review_clean, count(*) n_events from outc
"""
P = "coalesce(tp / nullif(tp + fp, 0), 0.0)"
RC = "coalesce(tp / nullif(tp + fn, 0), 0.0)"
F1 = f"coalesce(2 * {P} * {RC} / nullif({P} + {RC}, 0), 0.0)"


def wilson_sql(s: str, n: str) -> tuple[str, str]:
    p = f"({s} / {n}::double)"
    mid = f"({p} + 3.8416::double / (2 * {n})) / (1 + 3.8416::double / {n})"
    margin = f"(1.96::double / (1 + 3.8416::double / {n})) * sqrt({p} * (1 - {p}) / {n} + 3.8416::double / (4 * {n}::double * {n}))"
    return (
        f"case when {n} = 0 then 0.0 else round_even(greatest(0.0, {mid} - {margin}), 4) end::double",
        f"case when {n} = 0 then 0.0 else round_even(least(1.0, {mid} + {margin}), 4) end::double",
    )


PL, PH = wilson_sql("tp", "(tp + fp)")
RL, RH = wilson_sql("tp", "(tp + fn)")


@query(
    "confusion_3x2",
    """select band, count(event_id) filter (not is_fraud) clean, count(event_id) filter (is_fraud) fraud
       from (values ('ALLOW'), ('REVIEW'), ('BLOCK_REC')) b(band) left join outc on verdict = band group by 1""",
)
def _(ws):
    return R.confusion_3x2(ws.outcomes, D)


@query("outcome_counts", "select * from cnt", {"cnt": CNT})
def _(ws):
    return R.outcome_counts(ws.outcomes, D)


@query("precision_recall_f1", f"select tp, fp, fn, round_even({P}, 4)::double \"precision\", round_even({RC}, 4)::double recall, round_even({F1}, 4)::double f1 from cnt", {"cnt": CNT})
def _(ws):
    return R.precision_recall_f1(R.outcome_counts(ws.outcomes, D).select("tp", "fp", "fn"))


@query("wilson_interval", f"select tp, fp, fn, {PL} precision_low, {PH} precision_high, {RL} recall_low, {RH} recall_high from cnt", {"cnt": CNT})
def _(ws):
    counts = R.outcome_counts(ws.outcomes, D).select("tp", "fp", "fn", (F.col("tp") + F.col("fp")).alias("np"), (F.col("tp") + F.col("fn")).alias("nr"))
    return R.wilson_interval(R.wilson_interval(counts, "tp", "np", "precision"), "tp", "nr", "recall").drop("np", "nr")


RING = """
  select ring_id, count(*) events, count(*) filter (score >= 70) flagged, max(ring_strategy) strategy,
    round_even(count(*) filter (score >= 70) / count(*), 4)::double event_recall, count(*) filter (score >= 70) * 2 >= count(*) caught
  from outc where is_fraud group by 1
"""


@query("per_ring_recall", "select * from ring", {"ring": RING})
def _(ws):
    return R.per_ring_recall(ws.outcomes, D["block"])


@query(
    "ring_rollup",
    """select count(*) rings_total, count(*) filter (caught) rings_caught, count(*) filter (not caught) rings_missed,
         count(*) filter (strategy = 'sophisticated') sophisticated, count(*) filter (strategy = 'sophisticated' and caught) sophisticated_caught from ring""",
    {"ring": RING},
)
def _(ws):
    return R.ring_rollup(R.per_ring_recall(ws.outcomes, D["block"]))


COST = """
  select round_even(tp * 1100 * 1000.0::double / n_events, 2) gross_saved_inr, round_even(fp * 321 * 1000.0::double / n_events, 2) fp_cost_inr,
    round_even((review_fraud + review_clean) * 120 * 1000.0::double / n_events, 2) review_cost_inr,
    round_even((tp * 1100 - fp * 321 - (review_fraud + review_clean) * 120) * 1000.0::double / n_events, 2) net_saved_inr from cnt
"""


def with_review(counts):
    return counts.withColumn("review", F.col("review_fraud") + F.col("review_clean"))


@query("fp_cost_summary", COST, {"cnt": CNT})
def _(ws):
    return R.fp_cost_summary(with_review(R.outcome_counts(ws.outcomes, D)))


@query(
    "threshold_sensitivity",
    f"""select threshold, tp, fp, fn, round_even({P}, 4)::double "precision", round_even({RC}, 4)::double recall, round_even({F1}, 4)::double f1 from (
          select threshold, count(*) filter (score >= threshold and is_fraud) tp, count(*) filter (score >= threshold and not is_fraud) fp,
            count(*) filter (score < threshold and is_fraud) fn from outc, (values (60), (70), (80)) t(threshold) group by 1)""",
)
def _(ws):
    return R.threshold_sensitivity(ws.outcomes, D["block"])


DECILES = """
  select b bucket, min(score) lo, max(score) hi, cast(sum(events) as bigint) events, cast(sum(fraud) as bigint) fraud, round_even(sum(fraud) / sum(events), 4)::double fraud_rate from (
    select h.*, (select min(b) from range(1, 11) r(b) where b <= least(10, h.n)
       and h.i <= least(h.n, greatest(b, cast(round_even(b * (h.n / least(10, h.n)), 0) as bigint)))) b
    from (select score, count(*) events, count(*) filter (is_fraud) fraud, row_number() over (order by score) i, count(*) over () n from outc group by 1) h)
  group by 1
"""


@query("calibration_deciles", "select bucket, lo || '-' || hi score_range, events, fraud, fraud_rate from deci", {"deci": DECILES})
def _(ws):
    return R.calibration_deciles(ws.outcomes)


# evasion pack: ring payments by the signal they happen to dodge
def evasion_rows(ws):
    strategy = F.when(K() % 4 == 0, "slow_rate").when(K() % 4 == 1, "identity_rotation").when(K() % 4 == 2, "benign_mimicry").otherwise("partitioned")
    return ws.outcomes.where("is_fraud").withColumn("strategy", strategy)


EVA = {
    "eva": """select *, case cast(substr(event_id, 5) as bigint) % 4 when 0 then 'slow_rate' when 1 then 'identity_rotation' when 2 then 'benign_mimicry'
      else 'partitioned' end strategy from scored join lab using (event_id) where is_fraud"""
}


@query(
    "evasion_rates",
    """select strategy, count(*) events, count(*) filter (score < 35) missed_entirely, round_even(count(*) filter (score < 35) / count(*), 4)::double missed_entirely_rate,
         count(*) filter (score < 70) not_blocked, round_even(count(*) filter (score < 70) / count(*), 4)::double not_blocked_rate from eva group by 1""",
    EVA,
)
def _(ws):
    return R.evasion_rates(evasion_rows(ws), D)


@query(
    "evasion_residual_signals",
    """select strategy, reason_code, count(*) events from (select strategy, unnest(string_split(reason_codes, ',')) reason_code from eva)
       where reason_code <> '' group by all""",
    EVA,
)
def _(ws):
    return R.evasion_residual_signals(evasion_rows(ws))


# the report: held-out payments under the thresholds locked on the calibration split
REPORT = {
    **LOCK,
    "outc": f"select * from ({X.CTES['outc']}) where event_id in (select event_id from splitlab where split = 'test')",
    "banded": "select *, case when score >= block_at then 'BLOCK_REC' when score >= review_at then 'REVIEW' else 'ALLOW' end band from outc join locked on true",
    "cnt": """select count(*) filter (band = 'BLOCK_REC' and is_fraud) tp, count(*) filter (band = 'BLOCK_REC' and not is_fraud) fp,
        count(*) filter (band <> 'BLOCK_REC' and is_fraud) fn, count(*) filter (band = 'REVIEW' and is_fraud) review_fraud,
        count(*) filter (band = 'REVIEW' and not is_fraud) review_clean, count(*) n_events from banded""",
    "ring": """select ring_id, count(*) filter (band = 'BLOCK_REC') * 2 >= count(*) caught, max(ring_strategy) strategy,
        round_even(count(*) filter (band = 'BLOCK_REC') / count(*), 4)::double event_recall from banded where is_fraud and ring_id is not null group by 1""",
    "rr": "select count(*) rings_total, count(*) filter (caught) rings_caught, count(*) filter (not caught) rings_missed, count(*) filter (strategy = 'sophisticated') sophisticated, count(*) filter (strategy = 'sophisticated' and caught) sophisticated_caught from ring",
    "cost": COST,
    "q": f"select *, round_even({P}, 4)::double p, round_even({RC}, 4)::double r, round_even({F1}, 4)::double f from cnt",
    "sens": f"""select threshold, tp, fp, fn, round_even({P}, 4)::double p, round_even({RC}, 4)::double r, round_even({F1}, 4)::double f from (
        select block_at + d threshold, count(*) filter (score >= block_at + d and is_fraud) tp, count(*) filter (score >= block_at + d and not is_fraud) fp,
          count(*) filter (score < block_at + d and is_fraud) fn from banded, (values (-10), (0), (10)) v(d) group by 1)""",
    "deci": DECILES,
}


def _report_sql() -> str:
    rows = [("events", f"'{m}'", f"{e} from q") for m, e in (
        ("n_events", "n_events"), ("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("review_fraud", "review_fraud"), ("review_clean", "review_clean"),
        ("precision", "p"), ("recall", "r"), ("f1", "f"), ("precision_low", PL), ("precision_high", PH), ("recall_low", RL), ("recall_high", RH),
        ("design_point", "(p >= 0.8 and r >= 0.7)::int"))]
    rows += [("confusion", f"'{band.lower()}_{kind}'", f"count(*) filter (band = '{band}' and {'not ' * (kind == 'clean')}is_fraud) from banded")
             for band in ("ALLOW", "REVIEW", "BLOCK_REC") for kind in ("clean", "fraud")]
    rows += [("rings", f"'{m}'", f"{m} from rr") for m in ("rings_total", "rings_caught", "rings_missed", "sophisticated", "sophisticated_caught")]
    rows += [("missed_rings", "ring_id", "event_recall from ring where not caught")]
    rows += [("cost_per_1000", f"'{m}'", f"{m} from cost") for m in ("gross_saved_inr", "fp_cost_inr", "review_cost_inr", "net_saved_inr")]
    rows += [("sensitivity", f"'at_' || threshold || '_{m}'", f"{e} from sens") for m, e in (("tp", "tp"), ("fp", "fp"), ("fn", "fn"), ("precision", "p"), ("recall", "r"), ("f1", "f"))]
    rows += [("deciles", f"bucket || '_{m}'", f"{m} from deci") for m in ("lo", "hi", "events", "fraud", "fraud_rate")]
    rows += [("thresholds", f"'{m}'", f"{m}_at from locked") for m in ("review", "block")]
    parts = []
    for section, metric, source in rows:
        expression, table = source.rsplit(" from ", 1)
        parts.append(f"select '{section}' section, {metric} metric, cast({expression} as double) \"value\" from {table}")
    return " union all ".join(parts)


@query("evaluation_report", _report_sql(), REPORT)
def _(ws):
    """The held-out split under a locked configuration, which has to be there."""
    path = ws.folder("evaluated-config")
    thresholds, _quality = CA.lock_thresholds(ws.model_rows.where("split = 'calibration'"))
    store.save_model_config(ws.spark, {"weights": C.DEFAULT_WEIGHTS, "thresholds": thresholds, "model_version": C.MODEL_VERSION}, path)
    locked = store.load_model_config(ws.spark, path, required=True)
    held = ws.split_labels.where("split = 'test'").select("event_id")
    return R.evaluation_report(ws.outcomes.join(held, "event_id", "left_semi"), locked["thresholds"], stage)


@query(
    "design_point_check",
    "select tp, fp, fn, p \"precision\", r recall, f f1, p >= 0.8 and r >= 0.7 design_point from q",
    {"cnt": CNT, "q": f"select *, round_even({P}, 4)::double p, round_even({RC}, 4)::double r, round_even({F1}, 4)::double f from cnt"},
)
def _(ws):
    return R.design_point_check(R.outcome_counts(ws.outcomes, D).select("tp", "fp", "fn"))


# --- dataset -------------------------------------------------------------------
@query(
    "dataset_profile",
    """select 'total_events' metric, count(*)::double "value" from pay
       union all select 'fraud_events', count(*) from lab where is_fraud union all select 'clean_events', count(*) from lab where not is_fraud
       union all select 'fraud_outcome_share', round_even(avg((prior_outcome is not null)::int), 4) from pay join lab using (event_id) where is_fraud
       union all select 'rings', count(distinct ring_id) from lab
       union all select 'rings_standard', count(distinct ring_id) from lab where ring_strategy = 'standard'
       union all select 'rings_sophisticated', count(distinct ring_id) from lab where ring_strategy = 'sophisticated'
       union all select 'top_merchant_share', round_even(max(n) / sum(n), 4) from (select count(*) n from pay group by merchant_id)
       union all select 'median_clean_amount_paise', amount_paise from (
         select amount_paise, row_number() over (order by amount_paise) - 1 i, count(*) over () n from pay join lab using (event_id) where not is_fraud) where i = n // 2""",
)
def _(ws):
    return R.dataset_profile(ws.payments, ws.labels, stage)


@query("split_counts", "select split, count(*) filter (not is_fraud) clean, count(*) filter (is_fraud) fraud from splitlab group by 1")
def _(ws):
    return R.split_counts(ws.split_labels)


@query(
    "dataset_invariants",
    """select violation from (select unnest([case when n <> 1000 then 'total_events' end, case when f <> 100 then 'fraud_events' end, case when s < 1 then 'no_sophisticated_ring' end,
         case when abs(t1 / n - 0.6) > 0.1 then 'share_train' end, case when abs(t2 / n - 0.2) > 0.1 then 'share_calibration' end, case when abs(t3 / n - 0.2) > 0.1 then 'share_test' end,
         case when f2 < 8 then 'fraud_in_calibration' end, case when f3 < 8 then 'fraud_in_test' end]) violation
       from (select count(*) n, count(*) filter (is_fraud) f, count(*) filter (ring_strategy = 'sophisticated') s, count(*) filter (split = 'train') t1,
         count(*) filter (split = 'calibration') t2, count(*) filter (split = 'test') t3, count(*) filter (split = 'calibration' and is_fraud) f2,
         count(*) filter (split = 'test' and is_fraud) f3 from splitlab)) where violation is not null""",
)
def _(ws):
    return R.dataset_invariants(ws.split_labels, expected_total=1000, expected_fraud=100)


@query(
    "distribution_checks",
    """select 'top3_merchant_share' "check", round_even(sum(n) / any_value(t), 6)::double "value" from (
         select n, t from (select merchant_id, count(*) n, (select count(*) from pay) t from pay group by 1) order by n desc, merchant_id limit 3)
       union all select 'shared_devices', count(*) from (select device_id from pay where device_id is not null group by 1 having count(distinct customer_id) >= 2)
       union all select 'min_ring_merchants', min(m) from rings union all select 'min_ring_fanout', min(round_even(c / greatest(d, 1), 6)) from rings
       union all select 'min_sophisticated_spread_s', min(spread) from rings where strategy = 'sophisticated'
       union all select 'max_standard_spread_s', max(spread) from rings where strategy = 'standard'""",
    {"rings": """select ring_id, count(distinct merchant_id) m, count(distinct customer_id) c, count(distinct device_id) d, max(ts) - min(ts) spread, max(ring_strategy) strategy
       from pay join lab using (event_id) where is_fraud group by 1"""},
)
def _(ws):
    return R.distribution_checks(ws.payments, ws.labels)


@query(
    "merchant_share_rank",
    "select merchant_id, count(*) events, rank() over (order by count(*) desc) \"rank\", round_even(count(*) / sum(count(*)) over (), 6)::double share from pay group by 1",
)
def _(ws):
    return R.merchant_share_rank(ws.payments)


@query(
    "largest_ring_scenario",
    """select event_id, merchant_id, customer_id, amount_paise from pay join lab using (event_id) where ring_id = (
         select ring_id from pay join lab using (event_id) where ring_strategy = 'standard' group by 1
         order by count(distinct merchant_id) desc, count(*) desc, cast(substr(ring_id, 6) as bigint) limit 1)""",
)
def _(ws):
    return R.largest_ring_scenario(ws.payments, ws.labels).select("event_id", "merchant_id", "customer_id", "amount_paise")


@query("replay_feed_summary", "select count(*) filter (verdict = 'BLOCK_REC') blocked, count(*) filter (verdict = 'REVIEW') reviewed, round_even(avg(score), 6)::double mean_score from outc")
def _(ws):
    return R.replay_feed_summary(ws.outcomes)


@query(
    "identity_score_jump",
    """select node device, count(*) uses, arg_max(s.score, t.rn) - arg_min(s.score, t.rn) jump from touch t join scored s using (event_id)
       where t.ntype = 'device' group by 1 having count(*) >= 2""",
)
def _(ws):
    scored = ws.scored.select("event_id", "customer_id", "score")
    uses = ws.graph.timeline.where("device is not null").select("event_id", "customer_id", "device", "ord")
    return R.identity_score_jump(scored_uses(uses, scored, ws.graph.placed), "device", "ord")


def scored_uses(uses, scored, placed):
    """Events with their scores; where both are ``placed`` in customer buckets they meet there."""
    if not placed:
        return uses.join(scored.drop("customer_id"), "event_id")
    nobody = F.col("customer_id").isNull()  # no event id has two customers
    rest = uses.where(nobody).join(scored.where(nobody).drop("customer_id"), "event_id")
    return uses.join(scored, ["customer_id", "event_id"]).unionByName(rest)


@query(
    "loss_model_rollup",
    """select strftime(make_timestamp(ts * 1000000), '%Y-%m') "month", count(*) filter (is_fraud) * 1100 exposure_inr, count(*) filter (is_fraud and score >= 70) * 1100 recovered_inr,
         count(*) filter (not is_fraud and score >= 70) * 321 fp_cost_inr, count(*) filter (score between 35 and 69) * 120 review_cost_inr,
         count(*) filter (is_fraud and score >= 70) * 1100 - count(*) filter (not is_fraud and score >= 70) * 321 - count(*) filter (score between 35 and 69) * 120 net_saving_inr
       from outc group by 1""",
)
def _(ws):
    month = F.date_format(F.timestamp_micros(F.col("vts")), "yyyy-MM")
    return R.loss_model_rollup(ws.outcomes.withColumn("month", month), D)


# --- operational metrics -----------------------------------------------------------
@query(
    "verdict_band_counters",
    """select case when k % 13 = 0 then 'review' else lower(verdict) end band, count(*) verdicts, count(*) filter (k % 13 = 0) degraded
       from scored join (select event_id, k from pay) using (event_id) group by 1""",
)
def _(ws):
    """Some events lack a feature: their verdicts degrade and are counted."""
    partial = ws.graph.features.withColumn("n_f3", F.when(K() % 13 > 0, F.col("n_f3")))
    return O.verdict_band_counters(G.degraded_in_place(G.score_frame(partial)))


def latencies(ws):
    """One latency sample per line item, in whole microseconds."""
    micros = ((F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104_729) % 12_000_000).cast("long")
    return ws.table("lineitem").select("l_orderkey", "l_linenumber", micros.alias("us"))


LAT = {"lat": "select l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber * 104729) % 12000000 us from lineitem"}


@query(
    "latency_histogram",
    """select le, count(*) filter (b is null or us / 1000000.0::double <= b) bucket_count, count(*) total_count, round_even(cast(sum(us) as bigint) / 1000000.0::double, 6) total_sum
       from lat, (values ('0.005', 0.005::double), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5),
         ('5.0', 5.0), ('10.0', 10.0), ('+Inf', null)) v(le, b) group by 1""",
    LAT,
)
def _(ws):
    return O.latency_histogram(latencies(ws).withColumn("seconds", F.col("us") / 1_000_000))


@query(
    "score_drift",
    """select round_even(recent, 4)::double score_mean_recent, round_even(recent - base, 4)::double score_drift from
         (select avg(score) recent from (select score from outc order by rn desc limit 500)), (select avg(score) base from (select score from outc order by rn limit 500))""",
)
def _(ws):
    return O.score_drift(ws.outcomes, ["ord"])


@query(
    "latency_summary",
    """select (select count(*) from lat) events, round_even((select count(*) from lat) / ((select max(us) from lat) / 1000.0::double), 1) throughput_events_per_sec,
         max(us) filter (i = greatest(1, cast(ceil(0.5::double * n) as bigint))) / 1000.0::double p50_ms, max(us) filter (i = greatest(1, cast(ceil(0.95::double * n) as bigint))) / 1000.0::double p95_ms,
         max(us) filter (i = greatest(1, cast(ceil(0.99::double * n) as bigint))) / 1000.0::double p99_ms, max(us) / 1000.0::double max_ms from (
         select us, row_number() over (order by us) i, count(*) over () n from (select us, row_number() over (order by l_orderkey, l_linenumber) k from lat) where k > 50)""",
    LAT,
)
def _(ws):
    wall = F.max("us") / 1000
    out = O.latency_summary(latencies(ws), "us", ["l_orderkey", "l_linenumber"], wall, stage, digits=3)
    return out


@query(
    "latency_eval_percentiles",
    """select count(*) events, round_even(median(us) / 1000.0::double, 3) p50_ms, round_even(max(us) filter (i = cast(floor(0.95::double * n) as bigint)) / 1000.0::double, 3) p95_ms
       from (select us, row_number() over (order by us) - 1 i, count(*) over () n from lat)""",
    LAT,
)
def _(ws):
    return O.latency_eval_percentiles(latencies(ws), "us", stage)


# --- queues and log views ------------------------------------------------------------
@query("ranked_queue", "select event_id, score, verdict from scored order by score desc, event_id limit 50")
def _(ws):
    return Q.ranked_queue(ws.log).select("event_id", "score", "verdict")


@query("ranked_queue_review", "select event_id, score from scored where verdict = 'REVIEW' order by score desc, event_id limit 200")
def _(ws):
    return Q.ranked_queue(ws.log, "REVIEW", 200).select("event_id", "score")


@query("merchant_scoped_queue", "select event_id, score, merchant_id from scored where merchant_id = 'mcht_00003' order by score desc, event_id limit 50")
def _(ws):
    return Q.merchant_scoped_queue(ws.log, "mcht_00003").select("event_id", "score", "merchant_id")


@query("merchant_scope_after_limit", "select event_id, score from (select * from scored order by score desc, event_id limit 200) where merchant_id = 'mcht_00003'")
def _(ws):
    return Q.merchant_scoped_queue(ws.log, "mcht_00003", limit=200, scope_after_limit=True).select("event_id", "score")


def narrated_log(ws):
    """Verdict log after a narrative run over the flagged verdicts."""
    flagged = ws.log.where("verdict <> 'ALLOW'").select("event_id")
    told = model_responses(ws).join(flagged, "event_id", "left_semi")
    # staged: validation is read twice below and must not move ahead of the join
    narratives = N.validate_narratives(stage(told, "flagged_responses")).select(
        "event_id", F.to_json("narrative").alias("narrative"), N.narrative_status(F.col("parse_status")).alias("status")
    )
    latest = narratives.withColumn("created_at", F.lit(2))
    # each was explained before, with another result
    earlier = narratives.select("event_id", F.lit("{}").alias("narrative"), F.lit("SKIPPED").alias("status"), F.lit(1).alias("created_at"))
    return store.set_explanation(ws.log, latest.unionByName(earlier))


NARR = {
    "narr": """select *, case when verdict = 'ALLOW' then 'PENDING' when k % 7 in (0, 1, 2, 6) then 'DONE' else 'SKIPPED' end explanation_status
       from scored join (select event_id, k from pay) using (event_id)"""
}


@query("pending_explanations", "select event_id, score from narr where explanation_status = 'PENDING' order by score desc, event_id limit 100", NARR)
def _(ws):
    return Q.pending_explanations(narrated_log(ws), 100).select("event_id", "score")


@query("set_explanation", "select event_id, explanation_status, case when explanation_status = 'DONE' then '{\"summary\":\"event ' || event_id || '\",\"risk_factors\":[\"a\",\"b\"],\"recommended_action\":\"review\"}' end explanation from narr", NARR)
def _(ws):
    return narrated_log(ws).select("event_id", "explanation_status", "explanation")


@query("narrative_status_counts", "select explanation_status, count(*) verdicts from narr group by 1", NARR)
def _(ws):
    return O.narrative_status_counts(narrated_log(ws))


@query(
    "skipped_share",
    """select count(*) flagged, count(*) filter (explanation_status = 'SKIPPED') skipped, round_even(count(*) filter (explanation_status = 'SKIPPED') / count(*), 4)::double skipped_share
       from narr where verdict <> 'ALLOW'""",
    NARR,
)
def _(ws):
    return O.skipped_share(narrated_log(ws))


@query("get_verdict", "select p.wanted event_id, s.score, s.verdict from (select distinct case when k % 8 = 0 then 'gone' else '' end || event_id wanted from pay) p left join scored s on s.event_id = p.wanted")
def _(ws):
    wanted = ws.payments.select(F.concat(F.when(K() % 8 == 0, "gone").otherwise(""), "event_id").alias("event_id"))
    return Q.get_verdicts(ws.log, wanted).select("event_id", "score", "verdict")


@query("get_verdict_by_id", "select event_id, score from scored where verdict = 'BLOCK_REC'")
def _(ws):
    wanted = ws.scored.where("verdict = 'BLOCK_REC'").select(store.verdict_id(F.col("event_id")).alias("verdict_id"))
    return Q.get_verdicts(ws.log, wanted, "verdict_id").select("event_id", "score")


@query("verdict_exists", "select p.wanted event_id, s.event_id is not null \"exists\" from (select case when k % 8 = 0 then 'gone' else '' end || event_id wanted from pay) p left join scored s on s.event_id = p.wanted")
def _(ws):
    wanted = ws.payments.select(F.concat(F.when(K() % 8 == 0, "gone").otherwise(""), "event_id").alias("event_id"))
    return Q.verdict_exists(ws.log, wanted)


@query(
    "events_in_ingest_order",
    """select event_id, arrival, cast(row_number() over (order by arrival, event_id, amount_paise) - 1 as bigint) position from feed""",
    FEEDX,
)
def _(ws):
    feed = copied_feed(ws).select("event_id", "arrival", "amount_paise")
    return global_index(feed, [F.col("arrival"), F.col("event_id"), F.col("amount_paise")], "position", stage).select("event_id", "arrival", "position")


@query(
    "running_customer_mean",
    """select event_id, cast(sum(amount_paise) over w as bigint) amount_sum, count(*) over w amount_count, round_even(avg(amount_paise) over w, 4)::double mean_paise
       from ev window w as (partition by customer_id order by rn)""",
)
def _(ws):
    return ws.graph.progress.select(
        "event_id", "amount_sum", "amount_count", F.bround(F.col("amount_sum") / F.col("amount_count"), 4).alias("mean_paise")
    )


@query(
    "asof_edge_last_use",
    """select e.event_id, f.node upi, max(t.ts) last_use from ev e join (select c, arg_min(node, fl) node from lnk where ntype = 'upi' group by 1) f
         on f.c = e.customer_id left join touch t on t.c = e.customer_id and t.node = f.node and t.rn <= e.rn group by all""",
)
def _(ws):
    tl = ws.graph.timeline
    probes = tl.select("customer_id", "event_id", "vts", "ord").join(first_nodes(ws.graph.links, "upi"), "customer_id")
    return asof_edge_last_use(tl, probes, "upi", stage).select(
        "event_id", F.col("node").alias("upi"), F.floor(F.col("last_use_us") / C.SECOND).alias("last_use")
    )


@query(
    "entity_timeline",
    "select node, ntype, min(first_seen) first_seen, max(last_seen) last_seen, (select max(ts) from ev) - max(last_seen) idle_seconds from lnk group by all",
)
def _(ws):
    latest = ws.graph.timeline.agg(F.max("ts_us").alias("asof_us"))
    return LK.entity_timeline(ws.graph.entities, latest)


