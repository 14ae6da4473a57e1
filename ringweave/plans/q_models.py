"""Queries: splits, calibration, baselines, shadow model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.functions.scoring import contribution_columns, score_column
from ringweave.operators import calibrate as CA
from ringweave.operators import models as M
from ringweave.operators import reports as R
from ringweave.operators import splits as SP
from ringweave.plans.registry import query
from ringweave.session import stage
from ringweave.sources import store

# groups by falling size to the lightest fold
FOLD = {
    "grp": "select coalesce(ring_id, 'cust:' || customer_id) cv_group, count(*) n from splitlab group by 1",
    "gord": "select *, row_number() over (order by n desc, cv_group) i from grp",
    "kdeal": """
      select 0::bigint i, null::varchar cv_group, null::bigint fold, [0, 0, 0, 0, 0]::bigint[] l
      union all
      select i, cv_group, fold, [l[1] + case when fold = 0 then n else 0 end, l[2] + case when fold = 1 then n else 0 end, l[3] + case when fold = 2 then n else 0 end,
        l[4] + case when fold = 3 then n else 0 end, l[5] + case when fold = 4 then n else 0 end]::bigint[] from (
        select g.i, g.cv_group, g.n, x.l, cast(list_position(x.l, list_min(x.l)) - 1 as bigint) fold from kdeal x join gord g on g.i = x.i + 1)
    """,
    "modrow": """select s.*, f.fold from splitlab s join kdeal f on f.cv_group = coalesce(s.ring_id, 'cust:' || s.customer_id)""",
}


@query("assign_splits", "select event_id, split from splitlab")
def _(ws):
    return ws.split_labels.select("event_id", "split")


@query(
    "identity_leakage_check",
    """select key, count(distinct h) splits from (select key, cast(substr(event_id, 5) as bigint) % 3 h from ikeys) group by 1 having count(distinct h) > 1""",
)
def _(ws):
    leaky = ws.payments.select("event_id", (F.expr("substring(event_id, 5)").cast("long") % 3).cast("string").alias("split"))
    return SP.identity_leakage_check(SP.identity_keys(ws.payments), leaky)


@query(
    "no_leakage_in_splits",
    "select count(*) keys_checked, count(*) filter (n > 1) leaking from (select key, count(distinct split) n from ikeys join splitlab using (event_id) group by 1)",
)
def _(ws):
    keys = SP.identity_keys(ws.payments)
    leaking = SP.identity_leakage_check(keys, ws.split_labels).agg(F.count(F.lit(1)).alias("leaking"))
    checked = keys.join(ws.split_labels.select("event_id"), "event_id", "left_semi").agg(F.count_distinct("key").alias("keys_checked"))
    return checked.crossJoin(leaking)  # one row each


@query("ring_group", "select event_id, coalesce(ring_id, 'cust:' || customer_id) cv_group from lab join ev using (event_id)")
def _(ws):
    rows = ws.outcomes
    return rows.select("event_id", SP.ring_group(F.col("ring_id"), F.col("customer_id")).alias("cv_group"))


@query("group_kfold", "select cv_group, fold from kdeal where cv_group is not null", FOLD)
def _(ws):
    return ws.model_rows.select("cv_group", "fold").distinct()


@query(
    "metrics_at_threshold",
    """select tp, fp, fn, round_even(tp / (tp + fp), 6)::double "precision", round_even(tp / (tp + fn), 6)::double recall, round_even(2 * tp / (2 * tp + fp + fn), 6)::double f1 from (
         select count(*) filter (score >= 35 and is_fraud) tp, count(*) filter (score >= 35 and not is_fraud) fp, count(*) filter (score < 35 and is_fraud) fn from outc)""",
)
def _(ws):
    return CA.metrics_at_threshold(ws.outcomes, 35)


@query(
    "threshold_curve",
    """select threshold, tp, fp, fn, round_even(p, 6)::double "precision", round_even(r, 6)::double recall, round_even(f, 6)::double f1,
         row_number() over (order by f desc, threshold) = 1 is_best from (
         select *, case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end f from (
           select threshold, tp, fp, fn, tp / (tp + fp) p, tp / (tp + fn) r from (
             select t.score threshold, count(*) filter (o.score >= t.score and is_fraud) tp, count(*) filter (o.score >= t.score and not is_fraud) fp,
               count(*) filter (o.score < t.score and is_fraud) fn from outc o, (select distinct score from outc) t group by 1)))""",
)
def _(ws):
    return CA.threshold_curve(ws.outcomes)


@query(
    "cv_f1",
    """select round_even(avg(f1), 6)::double cv_f1 from (
         select h.fold, h.t, 2 * count(*) filter (m.score >= h.t and m.is_fraud)::double /
             (count(*) filter (m.score >= h.t) + count(*) filter (m.is_fraud)) f1 from (
           select fold, t from (
             select f.fold, t.score t, 2 * count(*) filter (m.score >= t.score and m.is_fraud)::double / nullif(count(*) filter (m.score >= t.score) + count(*) filter (m.is_fraud), 0) f1
             from (select distinct fold from fm) f, fm m, (select distinct fold, score from fm) t
             where m.fold <> f.fold and t.fold <> f.fold group by 1, 2)
           qualify row_number() over (partition by fold order by round(coalesce(f1, 0), 12) desc, t) = 1) h join fm m on m.fold = h.fold
         group by all having count(*) filter (m.is_fraud) > 0)""",
    {**FOLD, "fm": "select r.fold, r.is_fraud, s.score from modrow r join scored s using (event_id)"},
)
def _(ws):
    value = CA.cv_f1(ws.model_rows)
    return ws.spark.createDataFrame([(round(value, 6),)], "cv_f1 double")


LOCK = {
    "cal": "select s.score, l.is_fraud from scored s join splitlab l using (event_id) where l.split = 'calibration'",
    "hitt": """select *, round(case when p + r = 0 then 0.0 else 2 * p * r / (p + r) end, 12) f from (
      select t.score threshold, count(*) filter (o.score >= t.score and is_fraud) / count(*) filter (o.score >= t.score) p,
        coalesce(count(*) filter (o.score >= t.score and is_fraud) / nullif(count(*) filter (is_fraud), 0), 0) r
      from cal o, (select distinct score from cal) t group by t.score)""",
    "locked": """select coalesce((select min(threshold) from hitt where p >= 0.8 and r >= 0.7), (select threshold from hitt order by f desc, threshold limit 1)) block_at,
         least(coalesce((select min(threshold) from hitt where p >= 0.25), 101),
           coalesce((select min(threshold) from hitt where p >= 0.8 and r >= 0.7), (select threshold from hitt order by f desc, threshold limit 1))) review_at,
         exists (select 1 from hitt where p >= 0.8 and r >= 0.7) design_point_hit""",
}


@query("lock_thresholds", "select * from locked", LOCK)
def _(ws):
    thresholds, quality = CA.lock_thresholds(ws.model_rows.where("split = 'calibration'"))
    row = (thresholds["block"], thresholds["review"], quality["design_point_hit"])
    return ws.spark.createDataFrame([row], "block_at long, review_at long, design_point_hit boolean")


@query(
    "renormalize_weights",
    """select name, cast(v + case when row_number() over (order by v desc, i) = 1 then 100 - sum(v) over () else 0 end as bigint) weight from (
         select name, i, round_even(w * 100 / sum(w) over (), 0) v from (
           select 'burn_rotate' name, 1 i, count(*) filter (burn_rotate = 1) w from raw union all select 'taint_propagation', 2, count(*) filter (taint > 0) from raw
           union all select 'velocity_72h', 3, count(*) filter (velocity_merchants_72h >= 3) from raw))""",
)
def _(ws):
    row = ws.graph.features.agg(
        F.count_if(F.col("burn_rotate") == 1).alias("burn_rotate"),
        F.count_if(F.col("taint") > 0).alias("taint_propagation"),
        F.count_if(F.col("velocity_merchants_72h") >= 3).alias("velocity_72h"),
    ).first()
    return ws.spark.createDataFrame(list(CA.renormalize_weights(row.asDict()).items()), "name string, weight long")


@query("coordinate_ascent")
def _(ws):
    weights, fitted = CA.coordinate_ascent(train_rows(ws), stage)
    rows = [(n, w, round(fitted, 6)) for n, w in weights.items()]
    return ws.spark.createDataFrame(rows, "feature string, weight long, cv_f1 double")


def train_rows(ws):
    rows = ws.model_rows.where("split = 'train'").drop("fold")
    return stage(ws.with_folds(rows, 5), "train_rows", "zstd")


@query("calibrate")
def _(ws):
    config = CA.calibrate(train_rows(ws), ws.model_rows.where("split = 'calibration'"), rescored, stage)
    path = ws.folder("calibrated-config")
    store.save_model_config(ws.spark, config, path)
    locked = store.load_model_config(ws.spark, path, required=True)
    rows = [(n, w, locked["thresholds"]["review"], locked["thresholds"]["block"]) for n, w in locked["weights"].items()]
    return ws.spark.createDataFrame(rows, "feature string, weight long, review_at long, block_at long")


def rescored(rows, weights):
    """Rows with a fresh score under ``weights``."""
    return rows.drop("score").select("*", *contribution_columns(weights)).withColumn("score", score_column())


def _test(ws):
    return ws.model_rows.where("split = 'test'")


def _train_and_calibration(ws):
    """Baselines learn on both; three folds by group."""
    rows = ws.model_rows.where("split <> 'test'").drop("fold")
    return ws.with_folds(rows, 3)


@query("baseline_logistic")
def _(ws):
    model, _c = M.fit_logistic(_train_and_calibration(ws))
    return M.evaluate_model(model, _test(ws), "logistic_regression")


@query("baseline_gbt")
def _(ws):
    return M.evaluate_model(M.fit_gbt(_train_and_calibration(ws)), _test(ws), "gradient_boosting")


def challenger(ws):
    """Trained once per folder, then loaded from its artifact."""
    folder = ws.folder("challenger")
    model = M.load_challenger(ws.spark, folder)
    if model is None:
        M.train_challenger(ws.model_rows.where("split = 'train'"), folder)
        model = M.load_challenger(ws.spark, folder)
    return model


@query("train_challenger")
def _(ws):
    opinions = M.shadow_opinion(challenger(ws), ws.model_rows)
    return opinions.groupBy("flag").agg(F.count("*").alias("events"))


@query("shadow_opinion")
def _(ws):
    return M.shadow_opinion(challenger(ws), ws.model_rows)


@query("champion_challenger_agreement")
def _(ws):
    test = _test(ws)
    return R.champion_challenger_agreement(test, M.shadow_opinion(challenger(ws), test), C.DEFAULT_THRESHOLDS["block"])


# two rule sets stand in for champion and challenger, months for seeds
GATE = {
    "gate": """select strftime(make_timestamp(ts * 1000000), '%Y-%m') seed, is_fraud, score >= 70 champ, score >= 60 chall from outc""",
    "gm": """select seed, round_even(coalesce(2 * count(*) filter (champ and is_fraud) / nullif(count(*) filter (champ) + count(*) filter (is_fraud), 0), 0), 4) champion_f1,
        round_even(coalesce(2 * count(*) filter (chall and is_fraud) / nullif(count(*) filter (chall) + count(*) filter (is_fraud), 0), 0), 4) challenger_f1,
        round_even(coalesce(count(*) filter (champ and is_fraud) / nullif(count(*) filter (champ), 0), 0), 4) champion_precision,
        round_even(coalesce(count(*) filter (chall and is_fraud) / nullif(count(*) filter (chall), 0), 0), 4) challenger_precision,
        round_even(avg((champ = chall)::int), 4) agreement_rate from gate group by 1""",
}


@query(
    "promotion_gate",
    """select count(*) seeds, bool_and(challenger_f1 > champion_f1) and count(*) > 1 superior_across_seeds, bool_and(challenger_precision - champion_precision >= -0.02) no_precision_regression,
         bool_and(agreement_rate >= 0.95) agreement_soak, bool_and(challenger_f1 > champion_f1) and count(*) > 1 and bool_and(challenger_precision - champion_precision >= -0.02)
           and bool_and(agreement_rate >= 0.95) measurable_criteria_hold from gm""",
    GATE,
)
def _(ws):
    rows = ws.outcomes.select(
        F.date_format(F.timestamp_micros("vts"), "yyyy-MM").alias("seed"), "is_fraud", (F.col("score") >= 70).alias("champ"), (F.col("score") >= 60).alias("chall")
    )

    def quality(flag):
        tp, fp, fn = F.count_if(F.col(flag) & F.col("is_fraud")), F.count_if(F.col(flag) & ~F.col("is_fraud")), F.count_if(~F.col(flag) & F.col("is_fraud"))
        p, _r, f = R.quality_columns(tp, fp, fn)
        return F.bround(p, 4), F.bround(f, 4)

    (cp, cf), (hp, hf) = quality("champ"), quality("chall")
    per_seed = rows.groupBy("seed").agg(
        cf.alias("champion_f1"), hf.alias("challenger_f1"), cp.alias("champion_precision"), hp.alias("challenger_precision"),
        F.bround(F.avg((F.col("champ") == F.col("chall")).cast("int")), 4).alias("agreement_rate"),
    )
    return R.promotion_gate(per_seed)

