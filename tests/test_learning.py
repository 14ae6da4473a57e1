"""Splits, calibration and models."""

import random

import pytest
from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.operators import calibrate as CA
from ringweave.operators import models as M
from ringweave.operators import splits as SP
from ringweave.operators.graph import LinkGraph
from ringweave.plans.q_models import train_rows
from ringweave.plans.workspace import Workspace
from ringweave.session import stage
from ringweave.sources import store
from tests.test_graph import ring_stream


def one_by_one(histogram, targets):
    counts, out = [0] * len(targets), []
    for size, items in histogram:
        for _ in range(items):
            room = [t - n for t, n in zip(targets, counts)]
            pick = room.index(max(room))
            counts[pick] += size
            out.append(pick)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_allocation_plan_equals_one_by_one(seed):
    r = random.Random(seed)
    sizes = sorted({r.randint(1, 40) for _ in range(r.randint(1, 8))}, reverse=True)
    histogram = [(s, r.choice([1, 2, 3, 7, 50, 300, 2000])) for s in sizes]
    total = sum(a * b for a, b in histogram)
    targets = r.choice([[0.6 * total, 0.2 * total, 0.2 * total], [0.0] * 5, [0.0] * 3])
    plan = SP.allocation_plan(histogram, targets)
    assert [p[i % len(p)] for _, _, n, p in plan for i in range(n)] == one_by_one(histogram, targets)


def test_allocation_plan_stays_small():
    assert len(SP.allocation_plan([(3, 10), (1, 10**12)], [0.6e12, 0.2e12, 0.2e12])) < 60


def keys_frame(spark, links):
    rows = [(f"e{i}", c, k) for i, (c, k) in enumerate(links)] + [(f"s{c}", c, f"customer:{c}") for c in {c for c, _ in links}]
    return spark.createDataFrame(rows, "event_id string, customer_id string, key string")


def test_components_of_chain_star_and_loner(spark):
    r = random.Random(3)
    order = [f"c{i:03d}" for i in range(120)]
    r.shuffle(order)
    chain = [(c, f"k{i}") for i, c in enumerate(order)] + [(c, f"k{i + 1}") for i, c in enumerate(order)]
    star = [(f"s{i}", "hub") for i in range(50)]
    got = {r.customer_id: r.component for r in SP.identity_components(keys_frame(spark, chain + star + [("z", "own")]), stage).collect()}
    assert {got[c] for c in order} == {"c000"} and {got[f"s{i}"] for i in range(50)} == {"s0"} and got["z"] == "z"


def test_links_fall_round_by_round(spark):
    """A falling chain, a tree and a dense group: no link is carried that lies inside a group."""
    r, sizes = random.Random(4), []

    def counted(df, name):
        out = stage(df, name)
        if name == "component_links":
            sizes.append(out.count())
        return out

    chain = [(f"a{i:04d}", f"k{j}") for i in range(300) for j in (i, i + 1)]
    tree = [(f"t{i:03d}", f"t{j}") for i in range(1, 200) for j in (i, i // 2)]
    dense = [(f"g{i:02d}", f"g{r.randrange(40)}") for i in range(40) for _ in range(8)]
    got = {x.customer_id: x.component for x in SP.identity_components(keys_frame(spark, chain + tree + dense), counted).collect()}
    assert {got[f"a{i:04d}"] for i in range(300)} == {"a0000"} and {got[f"t{i:03d}"] for i in range(1, 200)} == {"t001"}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 0 and len(set(sizes)) == len(sizes) <= 7


def test_components_without_links(spark):
    assert {tuple(x) for x in SP.identity_components(keys_frame(spark, [("a", "x"), ("b", "y")]), stage).collect()} == {("a", "a"), ("b", "b")}
    assert SP.identity_components(keys_frame(spark, [("a", "x")]).limit(0), stage).collect() == []


def test_leak_is_reported(spark):
    keys = spark.createDataFrame([("e1", "c1", "customer:c1"), ("e2", "c1", "customer:c1")], "event_id string, customer_id string, key string")
    split = spark.createDataFrame([("e1", "train"), ("e2", "test")], "event_id string, split string")
    assert SP.identity_leakage_check(keys, split).count() == 1
    assert SP.identity_leakage_check(keys, split.withColumn("split", F.lit("train"))).count() == 0


ROW = "is_fraud boolean, fold long, " + ", ".join(f"{n} double" for n in CA.NORMALIZED)


def model_rows(spark, seed=5, n=160):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        fraud = r.random() < 0.3
        base = 0.7 if fraud else 0.3
        rows.append((fraud, i % 5, *[min(1.0, max(0.0, round(r.gauss(base, 0.3), 2))) for _ in range(7)]))
    return rows, spark.createDataFrame(rows, ROW)


def plain_score(values, weights):
    total = sum(round(weights[n] * v, 4) for n, v in zip(C.FEATURE_NAMES, values))
    return round(min(100.0, max(0.0, total)))


def plain_cv(rows, weights):
    scored = [(f, fold, plain_score(v, weights)) for f, fold, *v in rows]

    def f1(part, t):
        tp = sum(f and s >= t for f, _, s in part)
        fp = sum((not f) and s >= t for f, _, s in part)
        fn = sum(f and s < t for f, _, s in part)
        return 2 * tp / (2 * tp + fp + fn) if tp else 0.0

    out = []
    for fold in sorted({k for _, k, _ in scored}):
        rest, held = [x for x in scored if x[1] != fold], [x for x in scored if x[1] == fold]
        if any(f for f, _, _ in rest) and any(f for f, _, _ in held):
            best_t, best = 0, -1.0
            for t in sorted({s for _, _, s in rest}):
                if f1(rest, t) > best:
                    best_t, best = t, f1(rest, t)
            out.append(f1(held, best_t))
    return sum(out) / len(out)


def test_coordinate_ascent_ends_where_no_move_gains(spark, monkeypatch):
    rows, frame = model_rows(spark)
    monkeypatch.setattr(C, "ASCENT_PASSES", 50)
    start = plain_cv(rows, C.DEFAULT_WEIGHTS)
    assert CA.cv_f1(frame) == pytest.approx(start)
    fitted, score = CA.coordinate_ascent(frame, stage)
    assert sum(fitted.values()) == 100 and all(fitted[n] <= cap for n, cap in C.WEIGHT_CAPS.items())
    assert score == pytest.approx(plain_cv(rows, fitted)) and score > start
    around, allowed = CA.move_table(CA._vector(fitted))
    values = [plain_cv(rows, dict(zip(C.FEATURE_NAMES, w))) for w, ok in zip(around.tolist(), allowed) if ok]
    assert values and max(values) <= score + 1e-9


def test_first_gaining_move_is_taken(spark, monkeypatch):
    """One pass equals a walk along the list that takes every gain on its way."""
    rows, frame = model_rows(spark, seed=9)
    monkeypatch.setattr(C, "ASCENT_PASSES", 1)
    path = [CA._vector(C.DEFAULT_WEIGHTS)]
    for m in range(len(CA.MOVES)):
        table, allowed = CA.move_table(path[-1])
        values = [plain_cv(rows, dict(zip(C.FEATURE_NAMES, w.tolist()))) for w in (path[-1], table[m])]
        path.append(table[m] if allowed[m] and values[1] > values[0] + 1e-9 else path[-1])
    assert list(CA.coordinate_ascent(frame, stage)[0].values()) == path[-1].tolist()


def test_renormalize():
    assert sum(CA.renormalize_weights({**C.DEFAULT_WEIGHTS, "burn_rotate": 25}).values()) == 100
    assert CA.renormalize_weights(dict.fromkeys(C.FEATURE_NAMES, 0)) == C.DEFAULT_WEIGHTS


def test_thresholds_on_separable_scores(spark):
    rows = spark.createDataFrame([(s, s >= 60) for s in range(0, 100, 5)], "score long, is_fraud boolean")
    thresholds, quality = CA.lock_thresholds(rows)
    assert thresholds["review"] <= thresholds["block"] <= 60 and quality["design_point_hit"]


def test_config_round_trip(spark, tmp_path):
    path = str(tmp_path / "config")
    assert store.load_model_config(spark, path)["weights"] == C.DEFAULT_WEIGHTS
    with pytest.raises(FileNotFoundError):
        store.load_model_config(spark, path, required=True)
    store.save_model_config(spark, {"model_version": "v", "seed": 1, "weights": C.CALIBRATED_WEIGHTS, "thresholds": C.CALIBRATED_THRESHOLDS}, path)
    assert store.load_model_config(spark, path)["thresholds"] == C.CALIBRATED_THRESHOLDS


def test_models_learn_a_separable_set(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "GRID", (1.0,))
    rows = [(i % 4 == 0, i % 3, *([0.9 if i % 4 == 0 else 0.1] * 7)) for i in range(80)]
    frame = spark.createDataFrame(rows, ROW).withColumn("event_id", F.monotonically_increasing_id().cast("string")).coalesce(1)
    logistic, _ = M.fit_logistic(frame)
    assert M.evaluate_model(logistic, frame, "lr").first().f1 == 1.0
    folder = str(tmp_path / "challenger")
    assert M.load_challenger(spark, folder) is None and M.challenger_status(spark, folder) == "missing"
    M.train_challenger(frame, folder)
    assert M.challenger_status(spark, folder) == "ready"
    opinions = M.shadow_opinion(M.load_challenger(spark, folder), frame)
    assert opinions.join(frame, "event_id").where("flag = is_fraud").count() == 80
    monkeypatch.setattr(C, "CHALLENGER_VERSION", "newer")
    assert M.load_challenger(spark, folder) is None and M.challenger_status(spark, folder) == "stale"


def repeated_rows(spark):
    r = random.Random(5)
    kinds = [tuple(round(r.random(), 2) for _ in range(7)) for _ in range(40)]
    rows = [(r.random() < k[0], i % 3, *k) for i, k in enumerate(r.choices(kinds, k=900))]
    return rows, spark.createDataFrame(rows, ROW).coalesce(1)


def learnt_from(monkeypatch, learner):
    """(rows, their weight) that each fit of ``learner`` is given from now on."""
    seen, learn = [], learner._fit
    monkeypatch.setattr(learner, "_fit", lambda self, df: seen.append(df.agg(F.count("*"), F.sum("weight")).first()[:]) or learn(self, df))
    return seen


def alike(model, other, vectors):
    pairs = zip(*([x.p_fraud for x in M._probability(m, vectors).orderBy(*CA.NORMALIZED, "is_fraud").collect()] for m in (model, other)), strict=True)
    return all(abs(a - b) < 1e-4 for a, b in pairs)


def test_trees_learn_from_distinct_rows_as_from_all(spark, monkeypatch):
    rows, frame = repeated_rows(spark)
    vectors = M._vectors(frame)
    plain = M.GBTClassifier(featuresCol="vector", labelCol="label", maxDepth=3, maxIter=100, stepSize=0.1, seed=42).fit(vectors)
    seen = learnt_from(monkeypatch, M.GBTClassifier)
    assert alike(M.fit_gbt(frame), plain, vectors)
    assert seen == [(len({(x[0], *x[2:]) for x in rows}), 900.0)]


def test_logistic_learns_from_distinct_rows_as_from_all(spark, monkeypatch):
    rows, frame = repeated_rows(spark)
    vectors = M._vectors(frame).withColumn("weight", F.lit(1.0))
    seen = learnt_from(monkeypatch, M.LogisticRegression)
    model, best = M.fit_logistic(frame)
    assert seen[-1] == (len(set(rows)), 900.0)
    assert alike(model, M._logistic(best, 900).fit(vectors), vectors)


def odd_workspace(spark, **form):
    """Rows and labels that come twice, events without a time, a customer or a label."""
    number = F.expr("cast(substring(event_id, 2) as int)")
    rows = ring_stream(spark).withColumn("ts", F.when(number % 17 != 5, F.col("ts")))
    rows = rows.withColumn("customer_id", F.when(number % 19 != 7, F.col("customer_id"))).localCheckpoint()
    again = rows.where(number % 10 == 0).withColumn("ts", F.when(number % 20 == 0, F.col("ts")))
    ring = F.when(F.col("customer_id") < "c3", F.concat(F.lit("r"), number % 2))
    labels = rows.where(number % 23 != 3).select("event_id", ring.isNotNull().alias("is_fraud"), ring.alias("ring_id"), F.lit("standard").alias("ring_strategy"))
    ws = Workspace(spark, "odd rows")
    ws.payments = rows.unionByName(again).unionByName(rows.where(number % 30 == 0))
    ws.labels = labels.unionByName(labels.where(number % 15 == 0))
    ws.graph = LinkGraph(ws.payments, **form)
    return ws


def scored(ws):
    """With scores that are not at issue."""
    ws.scored = ws.graph.timeline.select("event_id", "customer_id", *[F.lit(0.0).alias(n) for n in CA.NORMALIZED], F.lit(0).alias("score"))
    return ws


def test_model_rows_by_customer_equal_those_by_event(spark):
    kept, spread = scored(odd_workspace(spark, bucket_events=20)), scored(odd_workspace(spark, hot_rows=4))
    columns = ["event_id", "customer_id", "is_fraud", "ring_id", "split", "cv_group", "fold", "score"]
    for read in (lambda ws: ws.model_rows, train_rows, lambda ws: ws.with_folds(ws.model_rows.drop("fold"), 3)):
        got, want = (sorted(map(str, read(ws).select(columns).collect())) for ws in (kept, spread))
        assert got == want and len(want) > 60
    assert kept.graph.placed and not spread.graph.placed
    got, want = (sorted(map(str, ws.split_labels.collect())) for ws in (kept, spread))
    assert got == want
    alone = odd_workspace(spark, bucket_events=20)  # splits without scoring
    assert sorted(map(str, alone.split_labels.collect())) == want and "timeline" not in alone.graph.__dict__


def test_model_rows_and_identities_meet_their_customer_without_a_shuffle(spark):
    ws = scored(odd_workspace(spark, bucket_events=20))
    assert ws.model_rows.count() > 60
    keys = SP.identity_keys(ws.graph.timeline.select("event_id", "customer_id", "raw.*"))
    rows = ws.scored.join(ws._customer_labels.hint("merge"), ["customer_id", "event_id"])
    for df in (rows, keys.select("customer_id", "key").distinct(), ws.model_rows.select("customer_id", "cv_group").distinct()):
        assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()
