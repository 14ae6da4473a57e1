"""Reports and operational metrics against known numbers."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.operators import ops_metrics as O
from ringweave.operators import queue as Q
from ringweave.operators import reports as R
from ringweave.plans import q_reports
from ringweave.session import stage
from ringweave.sources import store

OUT = "event_id string, score long, is_fraud boolean, ring_id string, ring_strategy string"


def outcomes(spark, rows):
    return spark.createDataFrame([(f"e{i}", *r) for i, r in enumerate(rows)], OUT)


def test_confusion_and_counts(spark):
    rows = [(s, f, None, None) for s in (10, 50, 90) for f in (True, False)]
    table = {(r.band): (r.clean, r.fraud) for r in R.confusion_3x2(outcomes(spark, rows), C.DEFAULT_THRESHOLDS).collect()}
    assert table == {b: (1, 1) for b in C.BANDS}
    n = R.outcome_counts(outcomes(spark, rows), C.DEFAULT_THRESHOLDS).first()
    assert (n.tp, n.fp, n.fn, n.review_fraud, n.review_clean) == (1, 1, 2, 1, 1)


def test_empty_bands_stay(spark):
    table = R.confusion_3x2(outcomes(spark, [(1, False, None, None)]), C.DEFAULT_THRESHOLDS).collect()
    assert sorted(r.band for r in table) == sorted(C.BANDS)


def test_published_quality_numbers(spark):
    row = spark.createDataFrame([(15, 3, 2, 66, 197)], "tp long, fp long, fn long, review long, n_events long")
    q = R.design_point_check(row).first()
    assert (q.precision, q.recall, q.f1, q.design_point) == (0.8333, 0.8824, 0.8571, True)
    p, r = R.wilson_columns(F.col("tp"), F.col("tp") + F.col("fp")), R.wilson_columns(F.col("tp"), F.col("tp") + F.col("fn"))
    assert tuple(row.select(*p).first()) == (0.6078, 0.9416)
    assert tuple(row.select(*r).first()) == (0.6566, 0.9671)
    assert tuple(R.fp_cost_summary(row).first()) == (83756.35, 4888.32, 40203.05, 38664.97)


def test_nothing_scored_divides_safely(spark):
    row = spark.createDataFrame([(0, 0, 0)], "tp long, fp long, fn long")
    assert tuple(R.precision_recall_f1(row).first())[3:] == (0.0, 0.0, 0.0)
    low, high = R.wilson_columns(F.col("tp"), F.col("tp") + F.col("fp"))
    assert tuple(row.select(low, high).first()) == (0.0, 0.0)


def test_ring_catch_rule(spark):
    rows = [(s, True, "r1", "standard") for s in (80, 90, 10, 20)] + [(s, True, "r2", "sophisticated") for s in (80, 10, 20)]
    rings = {r.ring_id: r for r in R.per_ring_recall(outcomes(spark, rows), 70).collect()}
    assert (rings["r1"].caught, rings["r2"].caught, rings["r2"].event_recall) == (True, False, 0.3333)


@pytest.mark.parametrize("scores", [[i % 101 for i in range(200)], [40] * 100 + [90] * 100, [5]])
def test_deciles_are_disjoint_and_complete(spark, scores):
    table = R.calibration_deciles(outcomes(spark, [(s, s > 50, None, None) for s in scores])).orderBy("bucket").collect()
    assert sum(r.events for r in table) == len(scores)
    assert len({r.score_range for r in table}) == len(table)


def test_evasion(spark):
    rows = spark.createDataFrame([("slow", 10), ("slow", 90), ("rotation", 50)], "strategy string, score long")
    got = {r.strategy: (r.missed_entirely, r.not_blocked) for r in R.evasion_rates(rows, C.DEFAULT_THRESHOLDS).collect()}
    assert got == {"slow": (1, 1), "rotation": (0, 1)}


def test_drift(spark):
    def drift(values):
        rows = spark.createDataFrame(list(enumerate(map(float, values))), "i int, score double")
        return tuple(O.score_drift(rows, ["i"], recent=5, baseline=10).first())

    assert drift([*range(10), 90, 95, 85, 92, 88]) == (90.0, 85.5)
    assert drift(range(4))[1] == 0.0


def test_latency_percentiles(spark):
    rows = spark.createDataFrame([(i, i * 1000) for i in range(1, 11)], "i long, us long")
    row = O.latency_summary(rows, "us", ["i"], F.lit(2.0), stage).first()
    assert (row.p50_ms, row.p95_ms, row.max_ms, row.throughput_events_per_sec) == (5.0, 10.0, 10.0, 5.0)
    assert O.latency_eval_percentiles(rows, "us", stage).first().p50_ms == 5.5
    many = spark.createDataFrame([(i, i * 1000) for i in range(1, 151)], "i long, us long")
    assert O.latency_summary(many, "us", ["i"], F.lit(1.0), stage).first().p50_ms == 100.0  # 51..150


def test_histogram_buckets(spark):
    rows = spark.createDataFrame([(0.003,), (0.02,), (20.0,)], "seconds double")
    table = {r.le: r.bucket_count for r in O.latency_histogram(rows).collect()}
    assert (table["0.005"], table["0.025"], table["10.0"], table["+Inf"]) == (1, 2, 2, 3)


def test_cost_uses_default_price_for_unknown_models(spark):
    calls = spark.createDataFrame([("zai.glm-5", 1_000_000, 0), ("other", 0, 1_000_000)], "model_id string, input_tokens long, output_tokens long")
    assert {r.model_id: r.cost_estimate_usd for r in O.llm_cost_estimate(calls).collect()} == {"zai.glm-5": 0.2, "other": 0.6}


def test_queue_scoping_and_limits(spark):
    log = spark.createDataFrame([(f"e{i:03d}", i % 50, "REVIEW", f"m{i % 4}", "PENDING") for i in range(200)], "event_id string, score long, verdict string, merchant_id string, explanation_status string")
    own = Q.merchant_scoped_queue(log, "m1", limit=10).collect()
    assert len(own) == 10 and {r.merchant_id for r in own} == {"m1"}
    assert len(Q.merchant_scoped_queue(log, "m1", limit=10, scope_after_limit=True).collect()) < 10
    with pytest.raises(ValueError):
        Q.ranked_queue(log, limit=201)


def test_upper_median_over_slices(spark):
    rows = spark.createDataFrame([(v,) for v in (5, 9000, 20_000, 20_000, 70_000, 1)], "v long")
    assert R.upper_median(rows, "v", stage).first().v == 20_000


def test_promotion_needs_more_than_one_seed(spark):
    schema = "seed int, champion_f1 double, challenger_f1 double, champion_precision double, challenger_precision double, agreement_rate double"
    one = [(1, 0.8, 0.9, 0.8, 0.8, 0.97)]
    assert not R.promotion_gate(spark.createDataFrame(one, schema)).first().measurable_criteria_hold
    assert R.promotion_gate(spark.createDataFrame([*one, (2, 0.7, 0.8, 0.8, 0.79, 0.96)], schema)).first().measurable_criteria_hold


def test_opinions_beside_verdicts(spark):
    log = spark.createDataFrame(
        [("a", 80, ["TAINT"], None), ("b", 0, [C.DEGRADED_CODE], None), ("c", 10, [], None), ("d", 10, [], '{"score":1,"probability":0.01,"flag":false}')],
        "event_id string, score long, reason_codes array<string>, challenger string",
    )
    said = [("a", 90, 0.9, True), ("a", 90, 0.9, True), ("b", 99, 0.99, True), ("c", 70, 0.7, True), ("c", 60, 0.6, True), ("gone", 5, 0.05, False)]
    opinions = spark.createDataFrame(said, "event_id string, score long, probability double, flag boolean")
    full = store.store_opinions(log, opinions)
    assert full.columns == log.columns
    got = {r.event_id: tuple(r)[1:] for r in store.stored_opinions(full).collect()}
    assert got == {"a": (90, 0.9, True), "c": (60, 0.6, True), "d": (1, 0.01, False)} and full.count() == 4
    again = {(r.event_id, r.challenger) for r in store.store_opinions(full, opinions).collect()}
    assert again == {(r.event_id, r.challenger) for r in full.collect()}  # safe to repeat
    assert store.stored_opinions(store.store_opinions(log.limit(0), opinions)).count() == 0
    row = R.champion_challenger_agreement(full.select("event_id", "score"), store.stored_opinions(full), 70).first()
    assert (row.events, row.both_flag, row.challenger_only, row.neither) == (3, 1, 1, 1)


HAND = [
    (90, True, "r1", "standard"), (40, True, "r1", "standard"), (80, True, "r2", "sophisticated"), (10, True, "r2", "sophisticated"),
    (20, True, "r2", "sophisticated"), (75, False, None, None), (5, False, None, None), (70, True, None, None), (60, False, "r1", None),
]


def report(spark, rows, thresholds=C.DEFAULT_THRESHOLDS):
    out = R.evaluation_report(outcomes(spark, rows), thresholds, stage).collect()
    assert len({(r.section, r.metric) for r in out}) == len(out)
    return {(r.section, r.metric): r.value for r in out}


def test_report_sections(spark):
    got = report(spark, HAND)
    assert [got["events", m] for m in ("n_events", "tp", "fp", "fn", "review_fraud", "review_clean")] == [9, 3, 1, 3, 1, 1]
    assert [got["confusion", m] for m in ("allow_clean", "allow_fraud", "review_clean", "review_fraud", "block_rec_clean", "block_rec_fraud")] == [1, 2, 1, 1, 1, 3]
    assert [got["rings", m] for m in ("rings_total", "rings_caught", "rings_missed", "sophisticated", "sophisticated_caught")] == [2, 1, 1, 1, 0]
    assert {k[1]: v for k, v in got.items() if k[0] == "missed_rings"} == {"r2": 0.3333}
    assert [got["sensitivity", f"at_{t}_tp"] for t in (60, 70, 80)] == [3, 3, 2] and got["sensitivity", "at_60_fp"] == 2
    assert sum(v for k, v in got.items() if k[0] == "deciles" and k[1].endswith("_events")) == 9
    assert (got["thresholds", "review"], got["thresholds", "block"]) == (C.DEFAULT_THRESHOLDS["review"], C.DEFAULT_THRESHOLDS["block"])


def test_report_agrees_with_its_single_parts(spark):
    rows = [(i * 37 % 101, i % 3 == 0, f"r{i % 7}" if i % 3 == 0 else None, "sophisticated" if i % 7 == 2 else None) for i in range(400)]
    bars = {"review": 30, "block": 55}
    got, given = report(spark, rows, bars), outcomes(spark, rows)
    whole = R.outcome_counts(given, bars).first().asDict()
    assert {m: got["events", m] for m in whole} == whole
    for r in R.confusion_3x2(given, bars).collect():
        assert (got["confusion", f"{r.band.lower()}_clean"], got["confusion", f"{r.band.lower()}_fraud"]) == (r.clean, r.fraud)
    missed = {r.ring_id: r.event_recall for r in R.per_ring_recall(given, 55).where("NOT caught").collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "missed_rings"} == missed
    for r in R.calibration_deciles(given).collect():
        assert f"{got['deciles', f'{r.bucket}_lo']:.0f}-{got['deciles', f'{r.bucket}_hi']:.0f}" == r.score_range


def test_report_without_outcomes(spark):
    got = report(spark, [])
    assert (got["events", "n_events"], got["events", "tp"], got["rings", "rings_total"], got["cost_per_1000", "net_saved_inr"]) == (0, 0, 0, 0)
    assert not [k for k in got if k[0] in ("missed_rings", "deciles")]


def test_report_reads_outcomes_once(spark):
    plan = R.outcome_cube(outcomes(spark, HAND), 70)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Scan ExistingRDD") == 1


def test_evaluation_needs_a_locked_configuration(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        store.load_model_config(spark, str(tmp_path / "none"), required=True)


def test_only_responses_of_flagged_verdicts_are_validated(spark, monkeypatch):
    ids = [f"evt_{i:09d}" for i in range(21)]
    log = [(e, ("ALLOW", "REVIEW", "BLOCK_REC")[i % 3], None, "PENDING") for i, e in enumerate(ids)]
    ws = SimpleNamespace(
        log=spark.createDataFrame(log, "event_id string, verdict string, explanation string, explanation_status string"),
        payments=spark.createDataFrame([(e,) for e in ids + ids[:3]], "event_id string"),
    )
    read, validate = [], q_reports.N.validate_narratives

    def counted(responses):
        read.extend(r.event_id for r in responses.collect())
        return validate(responses)

    monkeypatch.setattr(q_reports.N, "validate_narratives", counted)
    got = {r.event_id: r.explanation_status for r in q_reports.narrated_log(ws).collect()}
    assert sorted(read) == sorted(e for e in ids + ids[:3] if int(e[4:]) % 3)
    assert got == {e: "PENDING" if i % 3 == 0 else "DONE" if i % 7 in (0, 1, 2, 6) else "SKIPPED" for i, e in enumerate(ids)}
