"""Mixing sources to target weights with exact block quotas.

Each source is cut into blocks of documents of about equal words. Passes over a
source draw all its blocks; the last pass draws permuted blocks until the target
is met to the word, so one document of a source may be taken in part. The drawn
blocks of all sources are dealt to output shards by a splitting tree: each node
halves its shards and draws the left half's counts from the multivariate
hypergeometric distribution of its quotas. A shard then takes its next run of
each source's permuted blocks, so no block is drawn twice in a pass, and rows
are shuffled inside their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringweave.llm.common import documents
from ringweave.session import stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3  # a source is repeated at most so often
BLOCK_WORDS = 4096
MOST_BLOCKS = 65_536  # of one source; larger sources get larger blocks
SHARD_WORDS = 1 << 27
RUNS = 16  # of a shard, a power of two
SEED = 20


def _hash(*parts: Column | str | int) -> Column:
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def sized(df: DataFrame, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """Written table of ``doc_id, source, size, row, spot``; with ``keep_text`` also all columns of documents.

    ``row`` names a row (rows may be equal), ``spot`` is its place in the permutation of its source.
    """
    text = F.col("text").cast("string")
    kept = ["text", "lang", "n_chars"] if keep_text else []
    return stage(
        df.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
            _hash(seed, F.col("doc_id"), text).alias("spot"),
            *kept,
        ),
        "sized",
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: ``source, source_size, target, rank, blocks, passes, rest``.

    Sources by code point, null last, weigh ``weights`` in turn and share all words;
    none gets more than ``most`` times its size, what is over goes to the others by
    weight. The windows run over one row a source. Sources of size 0 have target 0.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sums = stage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = sums.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", turn)
    # fill by rising most * size / weight: the level if all below are full; it rises up to the true level and falls after it
    filled = ranked.withColumn("full_at", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    rising = Window.orderBy("full_at", "rank")
    earlier, later = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    leveled = filled.withColumn("at", left / F.sum("w").over(later))
    level = F.max("at").over(every)
    goal = leveled.withColumn(
        "target", F.when(level >= F.col("full_at"), F.lit(float(most)) * F.col("source_size")).otherwise(level * F.col("w"))
    )
    words = F.least(F.round("target").cast("long"), most * F.col("source_size"))
    block_words = F.greatest(F.lit(BLOCK_WORDS), F.ceil(F.col("source_size") / MOST_BLOCKS))
    size = F.col("source_size")
    return stage(
        goal.withColumn("words", words).select(
            "source",
            "source_size",
            "target",
            "rank",
            F.greatest(F.lit(1), F.ceil(size / block_words)).cast("long").alias("blocks"),
            F.when(size > 0, F.floor(F.col("words") / size)).otherwise(0).cast("long").alias("passes"),
            F.when(size > 0, F.col("words") % size).otherwise(0).cast("long").alias("rest"),
        ),
        "targets",
    )


def draws(placed: DataFrame, goals: DataFrame, seed: int = SEED) -> DataFrame:
    """Drawn blocks: ``source, block, pass, turn, words``; ``words`` is null where the whole block is taken.

    ``turn`` counts the draws of a source: pass by pass, blocks in the order of a seeded hash.
    A source has at most MOST_BLOCKS blocks, so its window is bounded.
    """
    blocks = stage(
        placed.groupBy("source", "block").agg(F.sum("size").alias("block_words")).where(F.col("block_words") > 0), "blocks"
    )
    goal = goals.select(F.col("source").alias("s"), "passes", "rest")
    many = blocks.join(goal, F.col("source").eqNullSafe(F.col("s"))).withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes").cast("int"))))
    order = Window.partitionBy("source", "pass").orderBy(_hash(seed, F.col("source"), F.col("block"), F.col("pass")), "block")
    before = F.coalesce(F.sum("block_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.count(F.lit(1)).over(Window.partitionBy("source", "pass"))
    drawn = many.withColumn("before", before).withColumn("turn", F.row_number().over(order) - 1 + F.col("pass") * n)
    last = F.col("pass") == F.col("passes")
    return drawn.where(~last | (F.col("before") < F.col("rest"))).select(
        "source",
        "block",
        "pass",
        "turn",
        F.when(last & (F.col("before") + F.col("block_words") > F.col("rest")), F.col("rest") - F.col("before")).alias("words"),
    )


def split(quotas: np.ndarray, shards: int, shard: int, seed: int) -> np.ndarray:
    """Blocks of every source in one shard: the path through the splitting tree.

    A node's draw is seeded by the node, so every shard sees the same draw at the
    nodes it shares with others, and the shards' counts add up to the quotas.
    """
    low, high = 0, shards
    counts = quotas.astype(np.int64)
    while high - low > 1:
        total, half = int(counts.sum()), (high - low) // 2
        random = np.random.default_rng([seed, low, high])
        left = random.multivariate_hypergeometric(counts, total * half // (high - low), method="marginals")
        if shard < low + half:
            high, counts = low + half, left
        else:
            low, counts = low + half, counts - left
    return counts


def deal(drawn: DataFrame, goals: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``drawn`` with its ``shard``. The quota vector (a number a source) goes to every shard's own tree path."""
    quotas = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("quota"))
    ranked = goals.select("source", "rank").alias("g").join(quotas.alias("q"), F.expr("g.source <=> q.source")).select("rank", "quota")
    vector = ranked.agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("v"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, v in zip(batch.column("shard").to_pylist(), batch.column("v").to_pylist(), strict=True):
                counts = split(np.array([x["quota"] for x in v], np.int64), shards, shard, seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["rank"] for x in v], pa.int64()), pa.array(np.full(len(v), shard), pa.int64()), pa.array(counts)],
                    ["rank", "shard", "count"],
                )

    leaves = drawn.sparkSession.range(shards).withColumnRenamed("id", "shard").join(F.broadcast(vector))
    counts = leaves.mapInArrow(run, "rank bigint, shard bigint, count bigint")
    runs = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    turns = counts.withColumn("first", F.coalesce(F.sum("count").over(runs), F.lit(0))).where("count > 0")
    turns = turns.select("rank", "shard", F.explode(F.sequence("first", F.col("first") + F.col("count") - 1)).alias("turn"))
    turns = turns.join(goals.select("rank", F.col("source").alias("s")), "rank").select("s", "turn", "shard")
    return drawn.join(turns, drawn.source.eqNullSafe(turns.s) & (drawn.turn == turns.turn)).select(drawn["*"], "shard")


class Mix:
    """The mix of one table of documents.

    ``rows`` is one row a document and pass: ``row, doc_id, source, shard, pass, words, place``,
    where ``words`` counts the words taken and ``place`` orders a shard. Documents
    without words are never taken. Null sources are a source of their own. Empty
    input gives no rows. Columns other than those of documents are left out.
    """

    def __init__(self, df: DataFrame, shards: int | None = None, seed: int = SEED, keep_text: bool = False) -> None:
        self.table = sized(df, seed, keep_text)
        self.goals = targets(self.table.select("source", "size"))
        goal = self.goals.select(F.col("source").alias("s"), "blocks")
        slim = self.table.select("row", "doc_id", "source", "size", "spot")
        placed = slim.join(goal, slim.source.eqNullSafe(goal.s)).withColumn("block", F.pmod("spot", "blocks")).drop("s", "blocks")
        if shards is None:
            total = self.goals.agg(F.sum("target")).first()[0] or 0
            shards = max(8, -(-int(total) // SHARD_WORDS))
        drawn = stage(deal(stage(draws(placed, self.goals, seed), "draws"), self.goals, shards, seed), "dealt")
        d = drawn.select(F.col("source").alias("s"), F.col("block").alias("b"), "pass", "shard", F.col("words").alias("room"))
        taken = placed.join(d, placed.source.eqNullSafe(d.s) & (placed.block == d.b)).where("size > 0")
        whole = taken.where("room IS NULL").withColumn("words", F.col("size"))
        # the last block of a source: its documents in order until the words are used up
        order = Window.partitionBy("source", "block").orderBy("spot", "row").rowsBetween(Window.unboundedPreceding, -1)
        part = taken.where("room IS NOT NULL").withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
        part = part.where("before < room").withColumn("words", F.least("size", F.col("room") - F.col("before"))).drop("before")
        self.rows = whole.union(part).select(
            "row", "doc_id", "source", "shard", "pass", "words", _hash(seed, F.col("shard"), F.col("pass"), F.col("spot")).alias("place")
        )

    def per_document(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every document."""
        taken = self.rows.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("taken"))
        g = self.goals.select(F.col("source").alias("s"), "source_size", "target")
        slim = self.table.select("row", "doc_id", "source", "size")
        return (
            slim.join(g, slim.source.eqNullSafe(g.s))
            .join(taken, slim.row == taken.r, "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
        )

    def mixed_documents(self) -> DataFrame:
        """Documents as often as drawn, shard by shard, shuffled inside a shard (needs ``keep_text``).

        A shard is written in RUNS runs of its order, each by one task, so tasks and files stay even with few shards.
        Documents are taken whole: the one that a source's target cuts is there if half of it or more was to be taken.
        """
        t, r = self.table, self.rows.select(F.col("row").alias("r"), "shard", "place", "words")
        out = t.join(r, t.row == r.r).where(F.col("words") * 2 >= F.col("size"))
        run = F.shiftright("place", 64 - RUNS.bit_length() + 1)  # the highest bits: runs follow each other in the order
        return out.repartition("shard", run).sortWithinPartitions("shard", "place", "row").select("doc_id", "text", "lang", "source", "n_chars")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(documents(spark, sf_dir)).per_document()
