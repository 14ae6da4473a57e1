"""Small shared pieces: tables, text segments, batches, components."""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.session import stage

#: characters handled together inside a task; longer texts are cut at safe places
SEGMENT_CHARS = 1 << 20


def importable(spark: SparkSession) -> None:
    """Let Python workers of a local session import this package from where it lies; on a cluster it is installed."""
    home, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), home]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


_CUT = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Pieces of ``text`` cut before a single space between two non-spaces.

    No pre-token, word or special string spans such a place, so the pieces can
    be tokenized on their own. Joined they give the text again.
    """
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Recent:
    """A memo of at most ``2 * size`` entries that keeps what is asked often."""

    def __init__(self, size: int) -> None:
        self.size, self.young, self.old = size, {}, {}

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def missing(self, keys: Iterable) -> list:
        """Distinct keys without a value; known ones move to the young half."""
        young, old, out = self.young, self.old, []
        for key in set(keys).difference(young):
            if key in old:
                young[key] = old[key]
            else:
                out.append(key)
        return out

    def room(self, wanted: int) -> None:
        """Start a new half when ``wanted`` more entries would not fit."""
        if self.young and len(self.young) + wanted > self.size:
            self.old, self.young = self.young, {}


def give_back() -> None:
    """Return memory that earlier work of this process has freed to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def tidy(run):
    """A ``mapInArrow`` function that holds no memory of tasks before it and leaves none: workers serve many stages."""

    def whole(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def crc_of(column: Column) -> Column:
    """crc32 of a value written as text; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``edges(a, b)``; the root is the smallest node reachable.

    Minimum labels travel over the links and then jump to their label's label,
    so the rounds grow with the logarithm of the longest path. Every round is a
    written table. Self-links and repeated links do no harm; null ends are left out.
    """
    links = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = stage(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(seen, labels.node == seen.a).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        target = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stage(lower.join(target, "root").select("node", "was", F.least("root", "next").alias("root")), "labels")
        labels = new.select("node", "root")
        if new.where(F.col("was") != F.col("root")).limit(1).count() == 0:
            return labels
