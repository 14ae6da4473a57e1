"""Append-only tables: ingest checks, verdict log, feedback, audit, artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ringweave import config as C
from ringweave import schema as SC


# --- reading and writing ---------------------------------------------------
def read_events_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Typed JSON-lines events, one row per line that is not blank.

    ``errors`` names what is wrong with a line (``malformed``, ``missing_event_id``,
    ``unknown_field:<name>``) and ``line`` keeps it for the quarantine; no line is lost.
    """
    schema = T.StructType([*SC.PAYMENTS.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    event = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select(F.col("value").alias("line"), event.alias("event")).select("line", "event.*")
    broken = F.col("_corrupt").isNotNull()
    keys = F.coalesce(F.json_object_keys("line"), F.array().cast("array<string>"))
    unknown = F.array_except(keys, F.array(*[F.lit(n) for n in SC.PAYMENTS.fieldNames()]))
    errors = F.when(broken, F.array(F.lit("malformed"))).otherwise(
        F.concat(
            F.when(F.col("event_id").isNull(), F.array(F.lit("missing_event_id"))).otherwise(F.array().cast("array<string>")),
            F.transform(F.array_sort(unknown), lambda n: F.concat(F.lit("unknown_field:"), n)),
        )
    )
    fields = [F.when(~broken, F.col(n)).alias(n) for n in SC.PAYMENTS.fieldNames()]
    return parsed.select(*fields, "line", errors.alias("errors"))


def row_digest(df: DataFrame) -> Column:
    """sha256 of each row as a JSON object, columns in name order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Order-free digest of a table: row count and the sums of the rows' digests, in four parts of 64 bits."""
    digested = df.select(row_digest(df).alias("h"))
    parts = [F.conv(F.substring("h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = [F.coalesce(F.sum(p).cast("string"), F.lit("0")) for p in parts]
    return digested.agg(
        F.lit(name).alias("artifact"),
        F.count(F.lit(1)).alias("n_rows"),
        F.concat_ws("-", *sums).alias("digest"),
    )


def write_event_label_artifacts(events: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """Write both artifacts as JSON lines and return their digests."""
    leaked = set(events.columns) & set(SC.LABEL_COLUMNS)
    if leaked:
        raise ValueError(f"label columns in serving events: {sorted(leaked)}")
    events.write.mode("overwrite").json(f"{folder}/events")
    labels.write.mode("overwrite").json(f"{folder}/labels")
    return fingerprint(events, "events").unionByName(fingerprint(labels, "labels"))


def serving_label_separation(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Leaked label columns, events without label, labels without event."""
    leaked = len(set(events.columns) & set(SC.LABEL_COLUMNS))
    unlabelled = events.join(labels, "event_id", "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    orphaned = labels.join(events, "event_id", "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    return (
        events.sparkSession.range(1)
        .select(F.lit("label_columns_in_events").alias("rule"), F.lit(leaked).cast("long").alias("violations"))
        .unionByName(unlabelled.select(F.lit("events_without_label").alias("rule"), "violations"))
        .unionByName(orphaned.select(F.lit("labels_without_event").alias("rule"), "violations"))
    )


# --- ingest ----------------------------------------------------------------
def validation_errors(extra_rules: dict[str, Column] | None = None) -> Column:
    """Names of the rules a row breaks; a rule passes when it is true."""
    required = ("event_id", "merchant_id", "customer_id", "amount_paise", "ts", "payment_method")
    rules = {f"missing_{c}": F.col(c).isNotNull() for c in required}
    rules["negative_amount"] = F.col("amount_paise").isNull() | (F.col("amount_paise") >= 0)
    rules["bad_payment_method"] = F.col("payment_method").isNull() | F.col("payment_method").isin(*C.PAYMENT_METHODS)
    rules["bad_prior_outcome"] = F.col("prior_outcome").isNull() | F.col("prior_outcome").isin(*C.FRAUD_OUTCOMES)
    rules.update(extra_rules or {})
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def validate_events(events: DataFrame, extra_rules: dict[str, Column] | None = None) -> DataFrame:
    """Rows with an ``errors`` array; unknown columns are rejected outright."""
    unknown = set(events.columns) - set(SC.PAYMENTS.fieldNames()) - {"ts_epoch", "arrival"}
    if unknown:
        raise ValueError(f"unknown event fields: {sorted(unknown)}")
    return events.withColumn("errors", validation_errors(extra_rules))


def not_future_dated(now: Column) -> dict[str, Column]:
    """Optional rule of the late-event policy."""
    return {"future_dated": F.col("ts").isNull() | (F.col("ts") <= now)}


def _arrival_order(feed: DataFrame, arrival: str):
    """Total order of an id's copies: arrival, then content; equal copies are interchangeable."""
    return Window.partitionBy("event_id").orderBy(arrival, row_digest(feed))


def first_arrivals(feed: DataFrame, arrival: str = "arrival") -> DataFrame:
    """First row per event id, the same on every run; copies are dropped before the shuffle."""
    return feed.withColumn("_n", F.row_number().over(_arrival_order(feed, arrival))).where("_n = 1").drop("_n")


def dedupe_ingest(feed: DataFrame, stored: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Rows to append: the first arrival of every id not stored yet."""
    fresh = feed.join(stored.select("event_id"), "event_id", "left_anti")
    return first_arrivals(fresh, arrival)


def ingest_batch_status(feed: DataFrame, stored: DataFrame, verdicts: DataFrame, arrival: str = "arrival", spooled: str | None = None) -> DataFrame:
    """Per item: accepted (one copy of a new id), duplicate, or spooled.

    Rows whose boolean column ``spooled`` is true wait for a replay: they are neither
    accepted nor compared. Duplicates carry their prior verdict.
    """
    known = stored.select("event_id", F.lit(True).alias("_known")).dropDuplicates(["event_id"])
    waits = F.coalesce(F.col(spooled), F.lit(False)) if spooled else F.lit(False)
    place = F.row_number().over(Window.partitionBy("event_id", "_waits").orderBy(arrival, row_digest(feed)))
    return (
        feed.withColumn("_waits", waits)
        .withColumn("_place", place)
        .join(known, "event_id", "left")
        .join(verdicts.select("event_id", F.col("verdict").alias("prior_verdict"), F.col("score").alias("prior_score")), "event_id", "left")
        .withColumn(
            "status",
            F.when(F.col("_waits"), "spooled").when(F.col("_known").isNull() & (F.col("_place") == 1), "accepted").otherwise("duplicate"),
        )
        .select(
            "event_id",
            arrival,
            "status",
            F.when(F.col("status") == "duplicate", F.col("prior_verdict")).alias("prior_verdict"),
            F.when(F.col("status") == "duplicate", F.col("prior_score")).alias("prior_score"),
        )
    )


def spool_and_replay(spooled: DataFrame, feed: DataFrame, stored: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Replay dead letters with the live feed; safe to repeat."""
    return dedupe_ingest(feed.unionByName(spooled), stored, arrival)


def event_row(events: DataFrame) -> DataFrame:
    """Persisted form of an event: enum text and ISO time."""
    keep = [c for c in SC.PAYMENTS.fieldNames() if c not in ("ts", "currency")]
    return events.select(*keep, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))


def events_in_ingest_order(events: DataFrame, ingested_at: str) -> DataFrame:
    return events.orderBy(ingested_at, "event_id")


# --- verdict log -----------------------------------------------------------
def verdict_id(event_id: Column) -> Column:
    """Stable id of an event's only verdict."""
    return F.substring(F.sha2(F.concat(F.lit("verdict:"), event_id), 256), 1, 32)


def verdict_payload(verdicts: DataFrame) -> DataFrame:
    """Stored shape of scored rows; evidence also names customer and merchant."""
    features = [*C.RAW_FEATURES, *[f"n_f{i}" for i in range(1, 8)]]

    def as_map(names: Sequence[str], prefix: str = "") -> Column:
        return F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]), F.array(*[F.col(prefix + n).cast("double") for n in names])
        )

    evidence = F.to_json(
        F.struct(
            "linked_merchants",
            "shared_devices",
            "taint",
            "taint_path",
            F.struct(F.col("cluster_customers").alias("customers"), "truncated").alias("cluster"),
            "customer_id",
            "merchant_id",
        )
    )
    return verdicts.select(
        verdict_id(F.col("event_id")).alias("verdict_id"),
        "event_id",
        "score",
        "verdict",
        "reason_codes",
        evidence.alias("evidence"),
        as_map(features).alias("features"),
        as_map(C.FEATURE_NAMES, "c_").alias("contributions"),
        "model_version",
        F.lit(C.SCHEMA_VERSION).alias("schema_version"),
        F.lit(None).cast("string").alias("explanation"),
        F.lit("PENDING").alias("explanation_status"),
        F.lit(None).cast("string").alias("challenger"),
        "merchant_id",
        "customer_id",
    )


def store_opinions(log: DataFrame, opinions: DataFrame) -> DataFrame:
    """Log with the shadow model's opinion (event_id, score, probability, flag) as JSON in ``challenger``.

    Degraded verdicts and events without an opinion keep what the log holds. An event has
    one opinion; of several the smallest JSON counts. The log is not rewritten.
    """
    said = F.to_json(F.struct("score", "probability", "flag"))
    one = opinions.groupBy("event_id").agg(F.min(said).alias("_said"))
    usable = ~F.array_contains("reason_codes", C.DEGRADED_CODE)
    joined = log.join(one, "event_id", "left")
    return joined.withColumn("challenger", F.when(usable, F.coalesce("_said", "challenger")).otherwise(F.col("challenger"))).select(log.columns)


def stored_opinions(log: DataFrame) -> DataFrame:
    """The opinions (event_id, score, probability, flag) that a log holds."""
    said = F.from_json("challenger", "score bigint, probability double, flag boolean")
    return log.where(F.col("challenger").isNotNull()).select("event_id", said.alias("_said")).select("event_id", "_said.*")


def append_verdicts(new: DataFrame, log: DataFrame) -> DataFrame:
    """Rows to append: one immutable verdict per event."""
    return new.join(log.select("event_id"), "event_id", "left_anti").dropDuplicates(["event_id"])


def append_feedback(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Feedback rows with a status: recorded, bad_decision or unknown_verdict."""
    known = log.select("verdict_id", F.lit(True).alias("_known")).dropDuplicates(["verdict_id"])
    return (
        feedback.join(known, "verdict_id", "left")
        .withColumn(
            "status",
            F.when(F.col("_known").isNull(), "unknown_verdict")
            .when(~F.col("analyst_decision").isin(*C.FEEDBACK_DECISIONS), "bad_decision")
            .otherwise("recorded"),
        )
        .drop("_known")
    )


def admin_audit_rows(requests: DataFrame, action: str, entity: Column, scope: str = "admin") -> DataFrame:
    return requests.select(F.lit(action).alias("action"), entity.alias("entity"), F.lit(scope).alias("scope"))


def set_explanation(log: DataFrame, narratives: DataFrame) -> DataFrame:
    """Log with narratives (event_id, narrative, status) attached; a view over
    two append-only tables, the log itself is never rewritten. The latest narrative
    of an event (by ``created_at`` where there is one, then by content) counts."""
    made = F.col("created_at") if "created_at" in narratives.columns else F.lit(0)
    latest = narratives.groupBy("event_id").agg(F.max(F.struct(made.alias("at"), "narrative", "status")).alias("last"))
    return (
        log.join(latest.select("event_id", "last.narrative", "last.status"), "event_id", "left")
        .withColumn("explanation", F.coalesce("narrative", "explanation"))
        .withColumn("explanation_status", F.coalesce("status", "explanation_status"))
        .drop("narrative", "status")
    )


def migrate_schema_add_column(old: DataFrame, name: str = "challenger", dtype: str = "string") -> DataFrame:
    """Old rows gain a nullable column; newer rows pass unchanged."""
    return old if name in old.columns else old.withColumn(name, F.lit(None).cast(dtype))


def load_model_config(spark: SparkSession, path: str | None = None, required: bool = False) -> dict:
    """Locked weights, thresholds and version; code defaults when absent."""
    defaults = {
        "weights": dict(C.DEFAULT_WEIGHTS),
        "thresholds": dict(C.DEFAULT_THRESHOLDS),
        "model_version": C.MODEL_VERSION,
    }
    if path is None or not path_exists(spark, path):
        if required:
            raise FileNotFoundError(f"no locked weights and thresholds at {path}")
        return defaults
    row = spark.read.schema(SC.MODEL_CONFIG).json(path).first()
    return {
        "weights": {n: row.weights[n] for n in C.FEATURE_NAMES},
        "thresholds": dict(row.thresholds),
        "model_version": row.model_version,
    }


def save_model_config(spark: SparkSession, config: dict, path: str) -> None:
    fields = [f.name for f in SC.MODEL_CONFIG.fields]
    spark.createDataFrame([tuple(config.get(f) for f in fields)], SC.MODEL_CONFIG).write.mode("overwrite").json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(hadoop_path)] if files.exists(hadoop_path) else []


def save_graph(nodes: DataFrame, links: DataFrame, folder: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    links.write.mode("overwrite").parquet(f"{folder}/links")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/links")
