"""Declared schemas. Readers never infer."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(spec: list[tuple]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in spec])


PAYMENTS = _struct(
    [
        ("event_id", _S, False),
        ("merchant_id", _S, False),
        ("customer_id", _S, False),
        ("amount_paise", _L, False),
        ("currency", _S, True),
        ("upi_vpa", _S, True),
        ("phone", _S, True),
        ("device_id", _S, True),
        ("email", _S, True),
        ("ip", _S, True),
        ("ts", _TS, False),
        ("payment_method", _S, False),
        ("prior_outcome", _S, True),
    ]
)
LABELS = _struct(
    [
        ("event_id", _S, False),
        ("is_fraud", _B, False),
        ("ring_id", _S, True),
        ("ring_strategy", _S, True),
        ("split", _S, True),
    ]
)
VERDICTS = _struct(
    [
        ("verdict_id", _S, False),
        ("event_id", _S, False),
        ("score", _L, False),
        ("verdict", _S, False),
        ("reason_codes", T.ArrayType(_S), True),
        ("evidence", _S, True),
        ("features", T.MapType(_S, _D), True),
        ("contributions", T.MapType(_S, _D), True),
        ("model_version", _S, False),
        ("schema_version", _S, False),
        ("explanation", _S, True),
        ("explanation_status", _S, False),
        ("challenger", _S, True),
        ("merchant_id", _S, True),
        ("customer_id", _S, True),
    ]
)
FEEDBACK = _struct(
    [("verdict_id", _S, False), ("analyst_decision", _S, False), ("note", _S, True)]
)
ADMIN_AUDIT = _struct([("action", _S, False), ("entity", _S, False), ("scope", _S, False)])
MODEL_CONFIG = T.StructType(
    [
        T.StructField("model_version", _S),
        T.StructField("seed", _L),
        T.StructField("weights", T.MapType(_S, _L)),
        T.StructField("thresholds", T.MapType(_S, _L)),
        T.StructField("cv_f1_train", _D),
        T.StructField("train_events", _L),
        T.StructField("calibration_events", _L),
        T.StructField("calibration_precision", _D),
        T.StructField("calibration_recall", _D),
        T.StructField("calibration_f1", _D),
        T.StructField("design_point_hit", _B),
    ]
)
NARRATIVE = T.StructType(
    [
        T.StructField("summary", _S),
        T.StructField("risk_factors", T.ArrayType(_S)),
        T.StructField("recommended_action", _S),
    ]
)
LABEL_COLUMNS = ("is_fraud", "ring_id", "ring_strategy", "split")
