"""Named queries over the given tables, each with its oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ringweave.plans.ctes import with_ctes
from ringweave.plans.workspace import Workspace, workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``fn(workspace) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Workspace], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(workspace(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, extra)
        return fn

    return add
