"""Row-level functions on hand-written values."""

import pytest
from pyspark.sql import functions as F

from ringweave import config as C
from ringweave.functions import narrative as N
from ringweave.functions import normalize as NZ
from ringweave.functions import scoring as S
from ringweave.operators.features import normalize_features
from ringweave.operators.graph import degrade_verdict, score_frame
from ringweave.operators.links import normalize_event_entities


def apply(spark, fn, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    return [r.v for r in rows.select("i", fn(F.col("raw")).alias("v")).orderBy("i").collect()]


def test_phones(spark):
    same = ["+919812345678", "919812345678", "00919812345678", "09812345678", "9812345678", "+91 98123 45678", "+91-98123-45678", "(0) 9812345678"]
    assert set(apply(spark, NZ.normalize_phone, same)) == {"+919812345678"}
    assert apply(spark, NZ.normalize_phone, ["  +918812345678  ", "+916000000000"]) == ["+918812345678", "+916000000000"]
    bad = ["+915812345678", "981234567", "98123456789", "abcdefghijk", "+9198123456789", "", None, "+91 12 45678", "++919812345678"]
    assert apply(spark, NZ.normalize_phone, bad) == [None] * len(bad)


def test_handles_devices_emails_addresses(spark):
    vpas = ["User At Bank@ybl", "  priya482@okhdfcbank  ", "PRIYA.482@YBL", "rahul-91_paytm@paytm", "x@ybl", "", None, "no-at-sign", "@ybl", "a@", "x" * 200 + "@ybl", "priya@ybl extra"]
    assert apply(spark, NZ.normalize_vpa, vpas) == [None, "priya482@okhdfcbank", "priya.482@ybl", "rahul-91_paytm@paytm", "x@ybl"] + [None] * 7
    assert apply(spark, NZ.normalize_device, ["  DEV_9F2A1C ", None, "x" * 200, "   "]) == ["dev_9f2a1c", None, None, None]
    assert apply(spark, NZ.normalize_email, ["  Priya.Sharma@GMAIL.com ", "not-an-email"]) == ["priya.sharma@gmail.com", None]
    assert apply(spark, NZ.normalize_ip, ["103.21.58.7", "103.21.58.999", "not-ip", None, " 010.0.0.1 "]) == ["103.21.58.7", None, None, None, "010.0.0.1"]


def test_bad_phone_is_kept_for_audit(spark):
    row = normalize_event_entities(
        spark.createDataFrame([(" Priya@YBL ", "12345", None, None, None)], "upi_vpa string, phone string, device_id string, email string, ip string")
    ).first()
    assert (row.upi_entity, row.phone_entity, row.unnormalized_phone) == ("priya@ybl", None, "12345")


def test_mask_and_node_ids(spark):
    assert apply(spark, NZ.mask_phone, ["+919812345678", None, "123"]) == ["+9198XXXX5678", None, "XXX"]
    assert apply(spark, NZ.node_value, ["device:a:b"]) == ["a:b"]
    assert apply(spark, NZ.node_type, ["device:a:b"]) == ["device"]


RAW = "event_id string, device_identity_ratio double, cross_merchant_fanout long, taint double, velocity_merchants_72h long, burn_rotate long, amount_band_hit double, new_identity_fraction double"


def test_score_bounds_and_codes(spark):
    rows = spark.createDataFrame([("hi", 9.0, 9, 1.0, 9, 1, 1.0, 1.0), ("lo", 0.0, 0, 0.0, 0, 0, 0.0, 0.0)], RAW)
    out = {r.event_id: r for r in score_frame(normalize_features(rows)).collect()}
    assert (out["hi"].score, out["hi"].verdict, len(out["hi"].reason_codes)) == (100, "BLOCK_REC", 6)
    assert (out["lo"].score, out["lo"].verdict, out["lo"].reason_codes) == (0, "ALLOW", [])
    assert out["hi"].c_taint_propagation == 24.0


def test_band_edges(spark):
    bands = spark.createDataFrame([(s,) for s in (34, 35, 69, 70)], "s int").select(S.band_column(F.col("s")).alias("b")).collect()
    assert [r.b for r in bands] == ["ALLOW", "REVIEW", "REVIEW", "BLOCK_REC"]


def test_weights_are_checked_and_read_by_name():
    shuffled = dict(reversed(list(C.DEFAULT_WEIGHTS.items())))
    assert S.validate_weights(shuffled) == []
    with pytest.raises(ValueError):
        S.checked_weights({**C.DEFAULT_WEIGHTS, "burn_rotate": 50})
    assert S.validate_weights({"x": 100}) == ["keys"]


def test_unknown_customer_degrades_to_review(spark):
    events = spark.createDataFrame([("e1", "c", "m")], "event_id string, customer_id string, merchant_id string")
    nothing = spark.createDataFrame([], "event_id string, score long, verdict string, reason_codes array<string>")
    row = degrade_verdict(events, nothing).first()
    assert (row.score, row.verdict, row.reason_codes, row.degraded) == (0, "REVIEW", ["SYS_DEGRADED"], True)


def test_narratives(spark):
    good = '{"summary":"s","risk_factors":["a"],"recommended_action":"r"}'
    texts = [f"```json\n{good}\n```", good, good + "\nthanks", "", "{broken", '{"summary":"s"}', f"Sure: {good} ok", '{"summary":"s","risk_factors":"a","recommended_action":"r"}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    got = [r.parse_status for r in N.validate_narratives(rows).orderBy("i").collect()]
    assert got == ["parsed", "parsed", "rescued", "invalid", "invalid", "invalid", "rescued", "invalid"]
    kinds = ['{"summary":1,"risk_factors":["a"],"recommended_action":"r"}', '{"summary":"s","risk_factors":[1],"recommended_action":"r"}',
             '{"summary":"s","risk_factors":["a"],"recommended_action":{"x":1}}', '{"summary":"s","risk_factors":[],"recommended_action":"r"}']
    rows = spark.createDataFrame(list(enumerate(kinds)), "i int, response string")
    assert [r.parse_status for r in N.validate_narratives(rows).orderBy("i").collect()] == ["invalid", "invalid", "invalid", "parsed"]
    assert apply(spark, N.strip_code_fences, ["```json\n{}\n```  ", " plain ", "```\na\nb```"]) == ["{}", "plain", "a\nb"]
