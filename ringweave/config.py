"""Every constant of the risk model, in one place.

Fixed values: thresholds, weights, costs and codes below are part of the
published model and must not drift.
"""

from __future__ import annotations

# --- identity graph -------------------------------------------------------
ENTITY_TYPES = ("upi", "phone", "device", "email")
FANOUT_TYPES = ("upi", "phone", "device")
NODE_TYPES = ("customer", "upi", "phone", "device", "email", "merchant")
FRAUD_OUTCOMES = ("chargeback", "refund_abuse", "confirmed_fraud")
PAYMENT_METHODS = ("upi", "card", "netbanking")
SPLITS = ("train", "calibration", "test")
RING_STRATEGIES = ("standard", "sophisticated")
# taint by number of hops from a confirmed-fraud customer
TAINT_BY_HOP = (1.0, 0.6, 0.36, 0.216)
CLUSTER_CAP = 200
MAX_RAW_LENGTH = 128

# --- features -------------------------------------------------------------
SECOND = 1_000_000  # event times are held in whole microseconds
VELOCITY_US = 72 * 3600 * SECOND
BURN_ROTATE_US = 48 * 3600 * SECOND
NEW_IDENTITY_US = 7 * 24 * 3600 * SECOND
AMOUNT_BAND_PAISE = (50_000, 200_000)

# --- scoring --------------------------------------------------------------
MODEL_VERSION = "rules-v1.0"
CALIBRATED_MODEL_VERSION = "rules-v1.1"
SCHEMA_VERSION = "1.0"
FEATURE_NAMES = (
    "device_identity_ratio",
    "cross_merchant_fanout",
    "taint_propagation",
    "velocity_72h",
    "burn_rotate",
    "amount_pattern",
    "new_identity_burst",
)
RAW_FEATURES = (
    "device_identity_ratio",
    "cross_merchant_fanout",
    "taint",
    "velocity_merchants_72h",
    "burn_rotate",
    "amount_band_hit",
    "new_identity_fraction",
)
DEFAULT_WEIGHTS = dict(zip(FEATURE_NAMES, (14, 20, 24, 14, 10, 4, 14)))
DEFAULT_THRESHOLDS = {"review": 35, "block": 70}
CALIBRATED_WEIGHTS = dict(zip(FEATURE_NAMES, (13, 5, 20, 12, 8, 7, 35)))
CALIBRATED_THRESHOLDS = {"review": 42, "block": 49}
BANDS = ("ALLOW", "REVIEW", "BLOCK_REC")
DEGRADED_CODE = "SYS_DEGRADED"

# --- cost model (INR) -----------------------------------------------------
FP_COST_INR = 321
FN_COST_INR = 1_100
REVIEW_COST_INR = 120
Z_95 = 1.96

# --- calibration ----------------------------------------------------------
DESIGN_PRECISION = 0.80
DESIGN_RECALL = 0.70
WEIGHT_STEPS = (-15, -10, -5, 5, 10, 15)
ASCENT_PASSES = 3
WEIGHT_CAPS = {"amount_pattern": 10}
REVIEW_PRECISION_FLOOR = 0.25
TARGET_SHARES = (("train", 0.6), ("calibration", 0.2), ("test", 0.2))
SPLIT_TOLERANCE = 0.10
MIN_SPLIT_FRAUD = 8
CHALLENGER_VERSION = "gbdt-challenger-1.0"
CHALLENGER_THRESHOLD = 0.5

# --- operations -----------------------------------------------------------
RECENT_WINDOW = 500
BASELINE_WINDOW = 500
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
LATENCY_WARMUP = 50
QUEUE_LIMIT_MIN, QUEUE_LIMIT_MAX, QUEUE_LIMIT_DEFAULT = 1, 200, 50
FEEDBACK_DECISIONS = ("CONFIRM_FRAUD", "CLEAR", "UNKNOWN")
# USD per million tokens (input, output); estimates for the cost log
PRICE_PER_MTOKEN = {
    "openai.gpt-oss-120b-1:0": (0.15, 0.60),
    "openai.gpt-oss-20b-1:0": (0.05, 0.20),
    "zai.glm-5": (0.20, 0.60),
    "amazon.nova-lite-v1:0": (0.06, 0.24),
}
DEFAULT_PRICE = (0.20, 0.60)

# --- execution ------------------------------------------------------------
# a key with more rows than this is scanned in time slices, not in one task
HOT_KEY_ROWS = 1_000_000
SLICE_US = 3600 * SECOND
# where no customer has more events than this, tables are kept in buckets of
# customers that hold about so many events
CALM_CUSTOMER_EVENTS = 100_000
BUCKET_EVENTS = 100_000
# hot keys sent as a broadcast table at most; beyond it the join is shuffled
MAX_BROADCAST_HOT_KEYS = 50_000
# customers with more events than this read their cluster once per change of it
# instead of once per event, when that saves at least the given factor
BUSY_CUSTOMER_EVENTS = 100_000
EPOCH_GAIN = 10
# customers active on more (merchant, day) pairs than this are counted once for
# all the clusters they belong to
HEAVY_CUSTOMER_SPANS = 20_000
# blocks of 32,768 merchants in which a customer has this many are held as a
# bitmap of 4,096 bytes, others as a list of at most as many bytes
DENSE_MERCHANTS = 512
FOREVER = 2**63 - 1
BEFORE_ALL = -(2**62)
