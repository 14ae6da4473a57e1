"""Streaming path: late events, replays, restarts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ringweave.session import stage
from ringweave.streaming import state
from ringweave.streaming.ingest import ScoringStream, read_event_stream
from ringweave.streaming.metrics import DedupeStream, DriftStream, stream_velocity
from ringweave.streaming.state import BucketTable, IdLedger, bucket_number, split_from
from tests.model import Model
from tests.test_online_features import as_frame, many


def test_late_events_are_scored_on_what_is_stored(spark, tmp_path):
    """Three arrival batches out of time order, one of them replayed."""
    events = many(range(500, 508))
    for i, e in enumerate(events):
        e["batch"] = (i * 7) % 3
    model, want = Model(), {}
    for e in sorted(events, key=lambda e: (e["batch"], e["ts"], e["event_id"])):
        model.add(e)
        want[e["event_id"]] = model.score(e)

    folder = str(tmp_path)
    scoring = ScoringStream(spark, folder, bucket_rows=60)  # some buckets, split as batches come
    for b in range(3):
        as_frame(spark, [e for e in events if e["batch"] == b]).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
        scoring = ScoringStream(spark, folder, bucket_rows=60)  # a restart between batches
        scoring.run(read_event_stream(spark, f"{folder}/feed", 10))
    last = as_frame(spark, [e for e in events if e["batch"] == 2])
    scoring.handle(last, 2)  # the same batch delivered again

    rows = scoring.verdicts.all().collect()
    assert len(rows) == len(events) == len({r.event_id for r in rows})
    for r in rows:
        w, f = want[r.event_id], r.features
        got = (f["device_identity_ratio"], f["cross_merchant_fanout"], f["taint"], f["velocity_merchants_72h"], f["burn_rotate"], f["amount_band_hit"], f["new_identity_fraction"])
        assert got == pytest.approx(tuple(float(w[k]) for k in ("f1", "f2", "f3", "f4", "f5", "f6", "f7"))), r.event_id


def test_bad_rows_are_quarantined_and_copies_dropped(spark, tmp_path):
    folder = str(tmp_path)
    good = as_frame(spark, many([600]))
    rows = good.unionByName(good).unionByName(good.limit(2).withColumn("event_id", F.concat(F.lit("bad"), "event_id")).withColumn("payment_method", F.lit("cash")))
    rows.write.parquet(f"{folder}/feed")
    scoring = ScoringStream(spark, folder)
    scoring.run(read_event_stream(spark, f"{folder}/feed", 100))
    assert scoring.stored_events().count() == good.count() == scoring.verdicts.all().count()
    assert scoring.quarantine.all().count() == 2


def test_copies_are_dropped_however_late(spark, tmp_path):
    rows = as_frame(spark, many([601]))
    late = rows.withColumn("ts", F.col("ts") - F.expr("interval 4000 days"))
    for part in (rows.unionByName(rows), late, rows.limit(3)):
        part.write.mode("append").parquet(f"{tmp_path}/feed")
        found = DedupeStream(spark, str(tmp_path), bucket_rows=5).run(read_event_stream(spark, f"{tmp_path}/feed", 100))
    assert sorted(found.collect()) == sorted(rows.select(*found.columns).collect())


def test_linear_hashing_splits_one_bucket_at_a_time(spark):
    numbers = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("h"))
    for n in (1, 2, 3, 7, 8, 12, 31):
        found = numbers.select(bucket_number(F.col("h"), n).alias("a"), bucket_number(F.col("h"), n + 3).alias("b")).distinct().collect()
        assert {r.a for r in found} == set(range(n))
        assert all(r.a == r.b or r.a == split_from(r.b, n) for r in found)


def size_of(paths):
    return sum(f.stat().st_size for p in paths for f in Path(p.removeprefix("file:")).glob("*.parquet"))


def test_state_reads_do_not_grow_with_history(spark, tmp_path, monkeypatch):
    """Small batches on a large table: rows are found, reads stay flat, a replayed batch changes nothing."""
    monkeypatch.setattr(state, "MOST_SEGMENTS", 2)
    table = BucketTable(spark, f"{tmp_path}/t", "k", bucket_rows=40)
    bounds, read = [0, 3000, *range(3010, 3130, 10)], []
    for b, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
        rows = stage(spark.range(lo, hi).select(F.col("id").cast("string").alias("k"), F.lit(b).alias("b")), "rows")
        table.opened.clear()
        table.put(rows, b)
        if b == 6:
            table.put(rows, b)
            table.opened.clear()
        assert table.lookup(rows.limit(5), b).count() == 5
        read.append(size_of(table.opened))
    assert table.all().count() == 3120 == table.all().select("k").distinct().count()
    assert table.all(4).count() == 3040
    assert sum(read[8:13]) <= 2 * sum(read[2:6]) and max(read) < size_of([p for p in map(str, Path(f"{tmp_path}/t/rows").glob("*/*"))]) / 4


def test_ledger_opens_only_buckets_that_may_hold_an_id(spark, tmp_path):
    ledger = IdLedger(spark, f"{tmp_path}/ids", bucket_rows=50)
    ids = lambda lo, hi: stage(spark.range(lo, hi).select(F.concat(F.lit("e"), "id").alias("event_id")), "ids")
    ledger.put(ids(0, 2000), 0)
    ledger.put(ids(2000, 2100), 1)
    ledger.opened.clear()
    assert ledger.fresh(ids(5000, 5200), 2).count() == 200
    assert len(ledger.opened) <= 3  # 42 buckets exist
    ledger.opened.clear()
    assert {r.event_id for r in ledger.fresh(ids(2099, 2102), 2).collect()} == {"e2100", "e2101"}
    assert 1 <= len(ledger.opened) <= 6
    assert ledger.fresh(ids(0, 2100), 2).count() == 0
    assert ledger.fresh(ids(0, 0), 2).count() == 0


def test_empty_batches(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", "k")
    none = spark.createDataFrame([], "k string, v int")
    table.put(none, 0)
    assert table.lookup(none, 0) is None and table.all() is None
    table.put(stage(spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"), "rows"), 1)
    table.put(none, 2)
    assert table.all().count() == 2 and table.lookup(none, 2) is None


def rows_in_state(spark, checkpoint):
    return spark.read.format("statestore").load(checkpoint).count()


def test_velocity_state_expires_and_late_rows_go(spark, tmp_path):
    """Uses of three days, then others a month later, then one far too late."""
    def uses(days, merchant):
        return spark.createDataFrame([(f"c{i}", merchant, d * 86400) for i in range(20) for d in days], "customer_id string, merchant_id string, s long").select(
            "customer_id", "merchant_id", F.timestamp_seconds("s").alias("ts")
        )

    held = []
    for part in (uses([100, 101, 102], "m"), uses([140], "n"), uses([141], "o"), uses([103], "late")):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        stream = spark.readStream.schema(part.schema).parquet(f"{tmp_path}/feed")
        found = stream_velocity(stream, "2 days", str(tmp_path))
        held.append(rows_in_state(spark, f"{tmp_path}/checkpoint"))
    rows = {(r.window_start // 86400, r.customer_id): r.merchants for r in found.collect()}
    assert rows[100, "c0"] == 1 and rows[139, "c0"] == 2 and rows[141, "c0"] == 1
    assert rows[103 - 1, "c0"] == 1 and (103, "c0") not in rows
    assert held[0] == 20 * 5 and held[-1] == 20 * 6  # windows of days 98-102, then those of 138-141


def test_drift_state_stays_bounded(spark, tmp_path):
    scores = spark.range(60).select((F.col("id") + 0.0).alias("score"), F.timestamp_seconds("id").alias("ts"), F.col("id").cast("string").alias("event_id"))
    for lo in (0, 20, 40):
        scores.where(F.col("id").between(lo, lo + 19)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    drift = DriftStream(spark, str(tmp_path), recent=5, baseline=10)
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    row = drift.run(stream).first()
    assert (row.score_mean_recent, row.score_drift) == (57.0, 52.5)
    assert drift.state.all().groupBy("batch").count().agg(F.max("count")).first()[0] <= 15
