"""Session helpers and staged tables.

A *stage* is an intermediate table written to the shared folder named by
``spark.checkpoint.dir``.  It cuts lineage, survives lost executors and keeps
column pruning and size statistics for whatever reads it next.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: dict[str, str] = {}


def build_session(app: str = "ringweave", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own."""
    cores = cpus if cpus is not None else os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's checkpoint folder.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = sc.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="ringweave-")
    return _LOCAL_ROOTS[app]


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """The same in ``buckets`` files by ``key``: joins, groups and windows on it need no shuffle.

    All rows of a key come to one task, so keys have to be small. Joins on the
    key and more columns find their rows in the same buckets too.
    """
    spark, unique = df.sparkSession, uuid.uuid4().hex
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    writer = df.repartition(buckets, key).write.option("path", f"{shared_root(spark)}/stages/{name}-{unique}")
    table = f"ringweave_{name}_{unique}"
    writer.option("compression", "zstd").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return spark.table(table)
