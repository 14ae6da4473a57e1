"""Hand-built graphs with known answers."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from ringweave.operators import cluster as CL
from ringweave.operators import features as FE
from ringweave.operators import links as L
from ringweave.operators import lookups as LK
from ringweave.operators import snapshots as SN
from ringweave.operators import taint as T
from ringweave.operators.graph import LinkGraph, degraded_in_place, score_frame
from ringweave.plans.q_reports import scored_uses
from ringweave.schema import PAYMENTS
from ringweave.session import stage, stage_by
from ringweave.sources import store
from ringweave.sources.payments import padded

T0 = 1_780_000_000


def events(spark, rows):
    """rows: (hours, customer, merchant, kwargs)."""
    out = []
    for i, (hours, c, m, kw) in enumerate(rows):
        ts = datetime.fromtimestamp(T0 + hours * 3600, timezone.utc)
        out.append((f"e{i:03d}", m, c, kw.get("amount", 90_000), "INR", kw.get("upi"), kw.get("phone"), kw.get("device"), kw.get("email"), None, ts, "upi", kw.get("outcome")))
    return spark.createDataFrame(out, PAYMENTS)


def nodes_of(graph):
    taint = T.taint_levels(graph.links, graph.customers)
    table = LK.build_nodes(graph.customers, graph.entities, taint, LK.last_snapshots(graph.snapshots))
    return {r.node: r for r in table.collect()}


def features_of(graph):
    return {r.event_id: r for r in graph.features.collect()}


def test_shared_device(spark):
    graph = LinkGraph(events(spark, [(0, "c1", "m1", {"device": "dev_a", "upi": "v1@ybl"}), (1, "c2", "m2", {"device": "dev_a", "upi": "v1@ybl"})]))
    nodes = nodes_of(graph)
    assert (nodes["device:dev_a"].linked_identity_count, nodes["device:dev_a"].merchant_count) == (2, 2)
    assert nodes["upi:v1@ybl"].merchant_count == 2
    assert nodes["customer:c1"].event_count == 1 and nodes["merchant:m1"].event_count == 0


def test_snapshot_is_stale_until_the_next_touch(spark):
    rows = [(0, "c1", "m1", {"device": "d"}), (1, "c1", "m2", {}), (2, "c1", "m3", {"device": "d"})]
    graph = LinkGraph(events(spark, rows))
    seen = {r.event_id: r.merchant_count for r in graph.snapshots.collect()}
    assert seen == {"e000": 1, "e002": 3}
    assert features_of(graph)["e001"].cross_merchant_fanout == 1
    early = LinkGraph(events(spark, rows[:2]))
    assert SN.current_counts(early.links).first().merchant_count == 2


@pytest.mark.parametrize("dense", [1, 7, 512])
def test_merchant_unions_equal_sets(spark, dense):
    r = random.Random(dense)
    merchants = {(f"c{c}", f"m{r.randrange(40_000)}") for c in range(30) for _ in range(r.choice((1, 5, 60)))}
    merchants |= {("c3", f"m{i}") for i in range(0, 40_000, 13)} | {("c4", f"m{i}") for i in range(0, 40_000, 17)}
    links = {(f"c{r.randrange(30)}", f"d{r.randrange(25)}") for _ in range(70)} | {("c3", f"x{i}") for i in range(50)} | {("c4", f"x{i}") for i in range(50)}
    links |= {("nobody", "d1")}
    found = SN.merchant_unions(spark.createDataFrame(sorted(links), "customer_id string, node string"), spark.createDataFrame(sorted(merchants), "customer_id string, merchant string"), dense)
    want = {}
    for c, n in links:
        want.setdefault(n, set()).update(m for o, m in merchants if o == c)
    assert {x.node: x.merchant_count for x in found.collect()} == {n: len(m) for n, m in want.items() if m}


def test_heavy_customers_list_no_pairs(spark, monkeypatch):
    """Two customers of 20,000 merchants on 200 shared devices: bitmaps, not 4 million pairs."""
    written = {}

    def counted(df, name):
        out = stage(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(SN, "stage", counted)
    merchants = spark.range(40_000).select(F.concat(F.lit("c"), F.col("id") % 2).alias("customer_id"), F.concat(F.lit("m"), F.col("id")).alias("merchant"))
    links = spark.range(400).select(F.concat(F.lit("c"), F.col("id") % 2).alias("customer_id"), F.concat(F.lit("d"), F.floor(F.col("id") / 2)).alias("node"))
    assert {tuple(r)[1] for r in SN.merchant_unions(links, merchants).collect()} == {40_000}
    assert written["merchant_lists"] == 0 and written["merchant_bitmaps"] == 200 * 2


def test_taint_levels_and_reach(spark):
    pair = LinkGraph(events(spark, [(0, "c1", "m1", {"device": "d", "outcome": "chargeback"}), (1, "c2", "m2", {"device": "d"})]))
    nodes = nodes_of(pair)
    assert [nodes[n].fraud_taint for n in ("customer:c1", "device:d", "customer:c2", "merchant:m1")] == [1.0, 0.6, 0.36, 0.0]
    chain = [(0, "c1", "m", {"device": "d1", "outcome": "confirmed_fraud"})]
    chain += [(i, f"c{i + 1}", "m", {"device": f"d{i}", "upi": f"u{i}@ybl"}) for i in (1,)]
    chain += [(2, "c3", "m", {"upi": "u1@ybl", "device": "d3"}), (3, "c4", "m", {"device": "d3"})]
    levels = {n: r.fraud_taint for n, r in nodes_of(LinkGraph(events(spark, chain))).items()}
    assert levels["upi:u1@ybl"] == 0.216 and levels["customer:c3"] == 0.0 and levels["customer:c4"] == 0.0


def test_taint_path_prefers_the_earliest(spark):
    rows = [(0, "f1", "m", {"device": "d", "outcome": "chargeback"}), (1, "f2", "m", {"device": "d", "outcome": "chargeback"}), (2, "c", "m", {"device": "d"})]
    paths = {r.event_id: r.taint_path for r in LinkGraph(events(spark, rows)).verdicts().collect()}
    assert paths == {"e000": [], "e001": ["f2", "d", "f1"], "e002": ["c", "d", "f1"]}


def test_cluster_stats_of_three_events(spark):
    rows = [
        (0, "c1", "m1", {"device": "d1", "upi": "u1@ybl", "phone": "9812345678", "email": "a@b.com"}),
        (1, "c2", "m2", {"device": "d1", "upi": "u2@ybl"}),
        (2, "c3", "m3", {"device": "d1", "phone": "9812345679"}),
    ]
    graph = LinkGraph(events(spark, rows))
    row = LK.cluster_stats(graph.members, LK.last_snapshots(graph.snapshots), graph.crowded).where("customer_id = 'c1'").first()
    assert (row.customers, row.devices, row.vpas, row.phones, row.emails, row.merchants) == (3, 1, 2, 2, 1, 3)
    assert (row.device_identity_ratio, row.max_cross_merchant_fanout) == (3.0, 3)


def test_hub_is_cut_at_the_cap(spark):
    graph = LinkGraph(events(spark, [(i, f"c{i:02d}", "m", {"device": "hub"}) for i in range(50)]))
    kept = LK.cluster_members_r(graph.links, 2, stage, cap=10).where("customer_id = 'c00'")
    assert kept.count() == 10 and {r.over_at for r in kept.collect()} == {2}
    small = LinkGraph(events(spark, [(i, f"c{i:02d}", "m", {"device": "hub"}) for i in range(12)]), cap=10)
    flags = {r.event_id: r.truncated for r in small.scores().collect()}
    # c00 .. c07 with hub and m are ten nodes; the ninth customer is one too many
    assert flags == {f"e{i:03d}": i > 7 for i in range(12)}
    assert all(r.truncated for r in LK.cluster_stats(small.members, LK.last_snapshots(small.snapshots), small.crowded).collect())


def test_velocity_window_edge(spark):
    rows = [(0, "c", "m1", {}), (2, "c", "m2", {}), (3, "c", "m3", {}), (74, "c", "m2", {})]
    assert features_of(LinkGraph(events(spark, rows)))["e003"].velocity_merchants_72h == 2


def test_burn_and_rotate(spark):
    burned = [(0, "c", "m", {"upi": "a@ybl", "device": "d"}), (1, "c", "m", {"upi": "a@ybl", "device": "d", "outcome": "chargeback"})]
    assert features_of(LinkGraph(events(spark, burned)))["e001"].burn_rotate == 0
    rotated = [*burned, (5, "c", "m", {"upi": "b@ybl", "device": "d"})]
    assert features_of(LinkGraph(events(spark, rotated)))["e002"].burn_rotate == 1
    # both handles are used again later, so neither counts as abandoned
    still_used = [*rotated, (60, "c", "m", {"upi": "a@ybl", "device": "d"}), (61, "c", "m", {"upi": "b@ybl", "device": "d"})]
    later = features_of(LinkGraph(events(spark, still_used)))
    assert (later["e003"].burn_rotate, later["e004"].burn_rotate) == (1, 0)


def test_amount_band_and_new_identities(spark):
    rows = [(0, "c1", "m", {"amount": 150_000, "device": "d"}), (0, "c9", "m", {"amount": 900_000}), (240, "c2", "m", {"amount": 150_000, "device": "d"})]
    f = features_of(LinkGraph(events(spark, rows)))
    assert (f["e000"].amount_band_hit, f["e001"].amount_band_hit) == (1.0, 0.0)
    assert (f["e000"].new_identity_fraction, f["e002"].new_identity_fraction) == (1.0, 0.5)


def test_phones_are_masked_on_nodes_and_edges(spark):
    graph = LinkGraph(events(spark, [(0, "c", "m", {"phone": "9812345678"})]))
    taint = T.taint_levels(graph.links, graph.customers)
    wanted = spark.createDataFrame([("c",), ("nobody",)], "customer_id string")
    view = (wanted, graph.members, graph.links, taint, graph.crowded)
    hidden = LK.cluster_view(*view).collect()
    assert not any("9812345678" in str(r) for r in hidden) and any("XXXX" in (r.id or "") for r in hidden)
    assert any("+919812345678" == r.id for r in LK.cluster_view(*view, unmask=True).collect())


def test_fingerprint_ignores_order_and_partitions(spark):
    links = LinkGraph(events(spark, [(i, f"c{i % 7}", f"m{i % 3}", {"device": f"d{i % 5}"}) for i in range(60)])).links.drop("fl_ord")
    prints = {tuple(store.fingerprint(links.repartition(n).orderBy(F.rand(n)), "links").first()) for n in (1, 5)}
    assert len(prints) == 1
    assert tuple(store.fingerprint(links.limit(10), "links").first()) not in prints


def test_digests_tell_like_looking_rows_apart(spark):
    pairs = [("a|b", "c"), ("a", "b|c"), (None, "c"), ("~", "c"), ("null", "c"), ('a","y":"b', "c")]
    rows = spark.createDataFrame(pairs, "x string, y string")
    assert rows.select(store.row_digest(rows)).distinct().count() == len(pairs)


def test_every_json_line_is_kept(spark, tmp_path):
    good = '{"event_id":"e1","merchant_id":"m","customer_id":"c","amount_paise":5,"ts":"2026-01-01T00:00:00.000Z","payment_method":"upi"}'
    lines = [good, "", "   ", good[:-9], good.replace('"event_id":"e1",', ""), good.replace("{", '{"is_fraud":true,"zz":1,'), good.replace(":5,", ':"five",'), "[1]"]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    found = {r.line: r for r in store.read_events_jsonl(spark, str(tmp_path / "in.jsonl")).collect()}
    assert set(found) == {x for x in lines if x.strip()}
    assert found[good].errors == [] and found[good].amount_paise == 5
    assert found[lines[3]].errors == ["malformed"] and found[lines[6]].errors == ["malformed"]
    assert found[lines[4]].errors == ["missing_event_id"]
    assert found[lines[5]].errors == ["unknown_field:is_fraud", "unknown_field:zz"] and found[lines[5]].event_id == "e1"


def test_ids_longer_than_their_padding_stay_apart(spark):
    numbers = spark.createDataFrame([(100_001,), (100_009,), (7,)], "n long")
    assert [r[0] for r in numbers.select(padded("mcht_", F.col("n"), 5)).collect()] == ["mcht_100001", "mcht_100009", "mcht_00007"]


def test_copies_of_one_arrival_are_accepted_once(spark):
    feed = spark.createDataFrame([("a", 1, 5), ("a", 1, 5), ("a", 1, 4), ("b", 1, 1)], "event_id string, arrival int, amount int")
    nothing = spark.createDataFrame([], "event_id string, verdict string, score long")
    found = store.ingest_batch_status(feed, nothing, nothing).where("status = 'accepted'").collect()
    assert sorted(r.event_id for r in found) == ["a", "b"]
    kept = {tuple(store.first_arrivals(feed.repartition(n)).where("event_id = 'a'").first()) for n in (1, 3)}
    assert len(kept) == 1


def test_latest_narrative_counts_once(spark):
    log = spark.createDataFrame([("e1", None, "PENDING"), ("e2", None, "PENDING")], "event_id string, explanation string, explanation_status string")
    told = spark.createDataFrame([("e1", "old", "SKIPPED", 1), ("e1", "new", "DONE", 2)], "event_id string, narrative string, status string, created_at int")
    rows = {r.event_id: (r.explanation, r.explanation_status) for r in store.set_explanation(log, told).collect()}
    assert rows == {"e1": ("new", "DONE"), "e2": (None, "PENDING")}


def test_an_event_without_features_degrades(spark):
    graph = LinkGraph(events(spark, [(0, "c", "m", {}), (1, "d", "m", {})]))
    partial = graph.features.withColumn("n_f4", F.when(F.col("event_id") == "e001", F.col("n_f4")))
    rows = {r.event_id: (r.score is None, r.verdict, r.degraded) for r in degraded_in_place(score_frame(partial)).collect()}
    assert rows == {"e000": (False, "REVIEW", True), "e001": (False, "ALLOW", False)}


def test_validation_and_unknown_fields(spark):
    good = events(spark, [(0, "c", "m", {})])
    bad = good.withColumn("amount_paise", F.lit(-1).cast("long")).withColumn("payment_method", F.lit("cash"))
    assert store.validate_events(bad).first().errors == ["negative_amount", "bad_payment_method"]
    with pytest.raises(ValueError):
        store.validate_events(good.withColumn("is_fraud", F.lit(True)))
    with pytest.raises(ValueError):
        store.write_event_label_artifacts(good.withColumn("is_fraud", F.lit(True)), good, "/nowhere")


def test_first_arrival_wins_even_when_most_rows_are_copies(spark):
    feed = spark.range(3000).select(F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("e"), "id")).alias("event_id"), F.col("id").alias("arrival"))
    stored = spark.createDataFrame([("e2999",)], "event_id string")
    got = store.dedupe_ingest(feed, stored)
    assert got.count() == 1000 and got.where("event_id = 'hot'").first().arrival == 0
    statuses = store.ingest_batch_status(feed, stored, spark.createDataFrame([("e2999", "REVIEW", 40)], "event_id string, verdict string, score long"))
    assert {r.status: r["count"] for r in statuses.groupBy("status").count().collect()} == {"accepted": 1000, "duplicate": 2000}


def ring_stream(spark, n=120):
    r = random.Random(5)
    rows = []
    for i in range(n):
        c = r.randrange(12)
        shared = {"device": f"d{c // 3}", "upi": f"u{c}@ybl", "email": f"c{c}@x.com"} if c < 6 else {"device": f"own{c}"}
        rows.append((i * 3, f"c{c}", f"m{r.randrange(9)}", {**shared, "amount": r.choice((30_000, 90_000, 400_000)), "outcome": r.choice((None,) * 9 + ("chargeback",))}))
    return events(spark, rows)


def test_customer_buckets_give_the_same_rows(spark):
    """Tables kept by customer against the form that spreads hot customers."""
    kept, spread = LinkGraph(ring_stream(spark), bucket_events=20), LinkGraph(ring_stream(spark), hot_rows=4)
    assert (kept._buckets, spread._buckets) == (6, 0)
    for table in ("features", "snapshots", "members"):
        names = [c for c in getattr(spread, table).columns if not c.endswith("ord")]
        got, want = (sorted(map(str, getattr(g, table).select(*names).collect())) for g in (kept, spread))
        assert got == want, table


def test_tables_kept_by_customer_are_not_shuffled_again(spark):
    graph = LinkGraph(ring_stream(spark), bucket_events=20)
    steps = (
        L.build_links(graph.timeline),
        L.customer_stats(graph.timeline),
        SN.event_progress(graph.timeline, graph.links, stage, graph._most_events),
        CL.own_nodes(graph.links),
    )
    for df in steps:
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_own_nodes_are_numbered_once_and_scoring_counts_handles_only(spark):
    graph = LinkGraph(ring_stream(spark), bucket_events=20)
    own = CL.own_nodes(graph._numbered_links, 3)
    assert "Window" not in own._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, own.collect())) == sorted(map(str, CL.own_nodes(graph.links, 3).collect()))
    assert graph.features.count() == 120 and "entities" not in graph.__dict__ and "hop1_idx" not in graph.links.columns


def test_private_entities_are_read_where_their_customer_lies(spark, monkeypatch):
    """Only reads of other entities are sent, and touches of customers whom somebody else reaches."""
    graph = LinkGraph(ring_stream(spark), bucket_events=20)
    sent = []

    def read(history, probes, *rest, **scan):
        sent.extend((history.collect(), probes.collect()))
        return read_snapshots(history, probes, *rest, **scan)

    read_snapshots = SN.read_snapshots
    monkeypatch.setattr(SN, "read_snapshots", read)
    joined = graph.timeline.join(graph.entity_reads, ["customer_id", "event_id"])
    history, probes = sent
    assert {r.node for r in probes if r.customer_id >= "c6"} == set()  # c6 to c9 share nothing
    assert not {r.node for r in history} & {f"device:own{c}" for c in range(6, 12)}
    assert {"device:d0", "upi:u1@ybl"} <= {r.node for r in probes}
    assert joined.count() == 120 and "Exchange hashpartitioning" not in joined.hint("merge")._jdf.queryExecution().executedPlan().toString()


def test_rows_of_other_members_are_read_before_they_are_sent(spark):
    wide = spark.range(50).selectExpr("cast(id % 5 as string) customer_id", "cast(id as string) member_id", "repeat('x', 999) days")
    theirs = stage_by(spark.range(50).selectExpr("cast(id as string) member_id", "id n"), "theirs", "member_id", 3)
    got = FE.of_members(wide, theirs, 3, lambda df: df.where("n > 4 and length(days) = 999").select("customer_id", "n"))
    assert got.count() == 45
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    tops = [line for line in plan.splitlines() if "RepartitionByExpression [customer_id" in line]
    below = [plan.splitlines()[i + 1] for i, line in enumerate(plan.splitlines()) if line in tops]
    assert tops and all("Project [customer_id" in line and "days" not in line for line in below)


def test_customers_that_share_an_event_id_are_not_kept_apart(spark):
    rows = ring_stream(spark, 20)
    twice = rows.unionByName(rows.withColumn("event_id", F.lit("e003")).limit(4))
    assert LinkGraph(rows)._buckets > 0 and LinkGraph(rows.unionByName(rows))._buckets > 0
    assert LinkGraph(twice)._buckets == 0


@pytest.mark.parametrize("form", [{}, {"hot_rows": 1}])
def test_a_touch_without_a_time_comes_before_its_dated_link(spark, form):
    rows = events(spark, [(0, "c", "m1", {"device": "d"}), (1, "c", "m2", {"device": "d"}), (2, "x", "m1", {"device": "e"})])
    undated = rows.withColumn("ts", F.when(F.col("event_id") == "e001", F.col("ts")))
    seen = {r.event_id: (r.merchant_count, r.linked_identity_count) for r in LinkGraph(undated, **form).snapshots.collect()}
    assert seen["e000"][1] == 0 and seen["e001"][1] == 1 and seen["e002"] == (1, 1)


def test_scores_meet_the_uses_of_a_device_at_their_customer(spark):
    graph = LinkGraph(ring_stream(spark).withColumn("customer_id", F.when(F.col("event_id") != "e007", F.col("customer_id"))), bucket_events=20)
    uses = graph.timeline.where("device is not null").select("event_id", "customer_id", "device", "ord")
    scores = stage_by(graph.timeline.select("event_id", "customer_id", F.lit(1).alias("score")), "scores", "customer_id", graph.placed)
    got, want = (sorted(map(str, scored_uses(uses, scores, placed).select("event_id", "device", "ord", "score").collect())) for placed in (graph.placed, 0))
    assert got == want and len(want) == uses.count()
    plan = scored_uses(uses, scores.hint("merge"), graph.placed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin [customer_id") == 1 and "Exchange hashpartitioning(customer_id" not in plan
