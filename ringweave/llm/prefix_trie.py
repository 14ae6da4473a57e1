"""Prefix trie of conversations with balanced parentheses per shard.

Turns become fingerprints, prefixes of a conversation become 128-bit keys (the
exclusive or of hashes of turn and position), so a distinct key is a node. Only
nodes that two or more conversations share go into the tries: a node of one
conversation has one leaf, no savings and at most one child. The distinct paths
of shared nodes are range-sorted into shards. Each shard writes its paths as
parentheses; a range min-max tree over blocks of excess finds the close of
every node, ranks of ``()`` pairs and cumulative arrays give leaves and savings
of subtrees. Nodes on the spine that neighbouring shards have in common are
counted once and their parts summed.

Defined results: rows without conv_id belong to no conversation; null role or
text is empty; turns with equal numbers (null first) are ordered by the md5 of
role length, role and text. Repeated rows are turns of their own. Empty tables
have no nodes. Other columns are left out.

Bounds: no task holds a conversation, node or group of copies; what a task
holds is a shard of about ``SHARD_NODES`` shared nodes (at least one path). The
ids that end in one node are written as texts of one batch each; SHA-256 is
sequential, so one task reads those texts of a node in order, one at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave.llm.common import crc_of, table
from ringweave.operators.scan import laid_out, prefixes
from ringweave.session import stage

FAMILY, LEADS = 100, 6
SHARD_NODES = 200_000
BLOCK = 256
KEY = ["depth", "k1", "k2"]

PARTS = "depth long, k1 long, k2 long, leaves long, saved long"
CHUNKS = "depth long, k1 long, k2 long, first_id long, ids string"
HASHES = "depth long, k1 long, k2 long, ends_sha256 string"


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with a range min-max tree over its excess."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK) -> None:
        excess = np.cumsum(np.where(bits == 1, 1, -1))
        self.block, self.excess = block, excess
        padded = np.full(-(-len(bits) // block) * block, len(bits) + 1)
        padded[: len(excess)] = excess
        self.rows = padded.reshape(-1, block)
        self.least = [self.rows.min(1)]
        while len(self.least[-1]) > 1:
            level = self.least[-1]
            level = np.append(level, len(bits) + 1) if len(level) % 2 else level
            self.least[-1] = level
            self.least.append(level.reshape(-1, 2).min(1))

    def first_at_most(self, block: np.ndarray, target: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Position of the first excess <= target in each block behind column ``after``, or -1."""
        out = np.empty(len(block), np.int64)
        for lo in range(0, len(block), 4096):
            cut = slice(lo, lo + 4096)
            hit = (self.rows[block[cut]] <= target[cut, None]) & (np.arange(self.block) > after[cut, None])
            found = hit.argmax(1)
            out[cut] = np.where(hit.any(1), block[cut] * self.block + found, -1)
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing position of each opening one."""
        target = self.excess[opens] - 1
        block = opens // self.block
        closes = self.first_at_most(block, target, opens % self.block)
        left = np.flatnonzero(closes < 0)
        at, wanted, level = block[left], target[left], np.full(len(left), -1)
        for height, least in enumerate(self.least):  # up to the first right-hand sibling that reaches the target
            climbing = level < 0
            sibling = np.minimum(at + 1, len(least) - 1)
            hit = climbing & (at % 2 == 0) & (sibling > at) & (least[sibling] <= wanted)
            level[hit], at[hit] = height, sibling[hit]
            at = np.where(climbing & ~hit, at // 2, at)
        for height in range(len(self.least) - 1, 0, -1):  # and down to its first such block
            down = level >= height
            first = np.minimum(at * 2, len(self.least[height - 1]) - 1)
            inside = self.least[height - 1][first] <= wanted
            at = np.where(down, np.where(inside, first, at * 2 + 1), at)
        closes[left] = self.first_at_most(at, wanted, np.full(len(left), -1))
        return closes


def shard_parts(rows: pa.Table) -> pa.Table:
    """Leaves and savings below each node of one shard, as far as this shard knows them."""
    rows = rows.sort_by("_at")
    column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
    lengths = pc.list_value_length(column["k1"]).to_numpy(zero_copy_only=False).astype(np.int64)
    k1, k2, own = (column[c].flatten().to_numpy() for c in ("k1", "k2", "own"))
    ends = np.cumsum(lengths)
    row = np.repeat(np.arange(len(lengths)), lengths)
    depth = np.arange(len(k1)) - (ends - lengths)[row]
    # a key stands for the whole prefix: equal keys at one depth are shared up to there
    above = (ends - lengths)[np.maximum(row - 1, 0)] + depth
    same = (row > 0) & (depth < lengths[np.maximum(row - 1, 0)])
    same &= (k1 == k1[np.where(same, above, 0)]) & (k2 == k2[np.where(same, above, 0)])
    shared = np.add.reduceat(same.astype(np.int64), ends - lengths)
    runs = np.zeros((len(lengths) + 1, 2), np.int64)  # closes, then opens, row by row
    runs[:-1, 1] = lengths - shared
    runs[1:-1, 0], runs[-1, 0] = lengths[:-1] - shared[1:], lengths[-1]
    bits = np.repeat(np.tile([0, 1], len(runs)), runs.ravel())

    new = ~same
    node_depth, node_own = depth[new], own[new].copy()
    held = int(column["held"][0].as_py())
    node_own[:held] = 0  # this spine's own savings are counted in an earlier shard
    last = np.zeros(len(k1), bool)
    last[ends - 1] = True
    alone = np.zeros(len(node_own), np.int64)  # leaves that hang below a node without being in the trie
    alone[last[new]] = column["alone"].to_numpy()

    opens = np.flatnonzero(bits == 1)
    closes = Parentheses(bits).findclose(opens)
    pair = np.append((bits[:-1] == 1) & (bits[1:] == 0), False)
    pair[opens[alone > 0]] = False  # not leaves: some lie below them
    if column["inner"][-1].as_py():
        pair[opens[-1]] = False  # its children are in the next shard
    ranks, first = np.cumsum(pair), np.arange(len(opens))
    after = first + (closes - opens + 1) // 2
    sums = {n: np.concatenate([[0], np.cumsum(v)]) for n, v in (("own", node_own), ("alone", alone))}
    return pa.table(
        {
            "depth": node_depth,
            "k1": k1[new],
            "k2": k2[new],
            "leaves": ranks[closes] - ranks[opens] + pair[opens] + sums["alone"][after] - sums["alone"][first],
            "saved": sums["own"][after] - sums["own"][first],
        }
    )


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``depth, k1, k2, conv_id`` rows as one text of ids a node and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in KEY]
        ids = batch.column("conv_id").to_numpy()
        change = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(change) + 1])
        texts = [",".join(map(str, piece.tolist())) for piece in np.split(ids, starts[1:])]
        yield pa.RecordBatch.from_arrays([*(pa.array(k[starts]) for k in keys), pa.array(ids[starts]), pa.array(texts)], ["depth", "k1", "k2", "first_id", "ids"])


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 a node over its sorted texts of ids, joined by commas."""

    def result(key, digest) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([digest.hexdigest()])], [*KEY, "ends_sha256"])

    key, digest = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*KEY, "ids")]
        for *own, ids in zip(*columns, strict=True):
            if own == key:
                digest.update(b",")
            else:
                if key is not None:
                    yield result(key, digest)
                key, digest = own, hashlib.sha256()
            digest.update(ids.encode())
    if key is not None:
        yield result(key, digest)


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, m`` (a fingerprint of role and text), ``chars``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("m"),
        F.length(text).cast("long").alias("chars"),
    )


def mark(seed: int, depth: Column, m: Column) -> Column:
    return F.xxhash64(F.lit(seed), depth.cast("long"), m)


def visits_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, p1, p2, chars``: every turn of every rebuilt conversation with its own and its parent's key."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    in_order = Window.partitionBy("conv_id").orderBy("turn", "m")
    first = turns.where(F.col("conv_id") % FAMILY == 0).withColumn("i", F.row_number().over(in_order)).where(F.col("i") < LEADS)
    first = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "m", "chars"))).alias("first"))
    first = stage(first.select(F.col("conv_id").alias("base"), "first"), "trie_leads")

    h = (crc_of(F.col("conv_id")) % LEADS).cast("int")
    lead = F.slice(F.coalesce("first", F.array().cast(first.schema["first"].dataType)), 1, h)

    def key_of(seed: int, part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(mark(seed, x["i"], x["m"])))

    def keys_up_to(n: Column) -> list[Column]:
        return [key_of(seed, F.slice("lead", 1, n)) for seed in (1, 2)]

    own = turns.withColumn("base", base).join(first, "base", "left").withColumn("lead", lead)
    own = own.select("conv_id", "turn", "m", "chars", h.alias("h"), F.size("lead").alias("n_lead"), *[k.alias(f"l{s}") for s, k in enumerate(keys_up_to(F.size("lead")), 1)])
    own = laid_out(own, ["conv_id", "turn", "m"], stage, "trie_turns")
    own = prefixes(own, "conv_id", {"pos": (F.sum, F.lit(1), lambda a, b: a + b)}).where("pos > h")
    own = own.withColumn("depth", F.col("n_lead") + F.col("pos") - F.col("h"))
    own = own.select("*", *[mark(s, F.col("depth"), F.col("m")).alias(f"t{s}") for s in (1, 2)])
    own = stage(own, "trie_depths")
    own = prefixes(own, "conv_id", {f"x{s}": (F.bit_xor, F.col(f"t{s}"), lambda a, b: a.bitwiseXOR(b)) for s in (1, 2)})
    own = own.select("conv_id", "depth", *[F.col(f"l{s}").bitwiseXOR(F.col(f"x{s}")).alias(f"k{s}") for s in (1, 2)], *[f"t{s}" for s in (1, 2)], "chars")
    own = own.select("conv_id", "depth", "k1", "k2", *[F.col(f"k{s}").bitwiseXOR(F.col(f"t{s}")).alias(f"p{s}") for s in (1, 2)], "chars")

    led = convs.withColumn("base", base).join(first, "base").withColumn("lead", lead).select("conv_id", "lead", F.explode("lead").alias("x"))
    depth = F.col("x.i")
    led = led.select(
        "conv_id", depth.cast("long").alias("depth"),
        *[k.alias(f"k{s}") for s, k in enumerate(keys_up_to(depth), 1)],
        *[k.alias(f"p{s}") for s, k in enumerate(keys_up_to(depth - 1), 1)],
        F.col("x.chars").alias("chars"),
    )
    return own.unionByName(led)


def subtree_sums(paths: DataFrame, nodes_on_paths: int) -> DataFrame:
    """``leaves`` and ``saved`` of every shared node's subtree."""
    shards = max(1, math.ceil(nodes_on_paths / SHARD_NODES))
    keys = F.arrays_zip("k1", "k2")
    placed = paths.withColumn("keys", keys).repartitionByRange(shards, "keys").sortWithinPartitions("keys")
    placed = stage(placed.select("*", F.monotonically_increasing_id().alias("_at")), "trie_paths").withColumn("shard", F.shiftright("_at", 33))
    # one row a shard: how much of its first path the shard before has open at its end
    edges = placed.groupBy("shard").agg(F.min_by("keys", "_at").alias("head"), F.max_by("keys", "_at").alias("tail"))
    held = edges.select("shard", F.size(F.array_intersect("head", F.lag("tail").over(Window.orderBy("shard")))).alias("held"))
    rows = placed.drop("keys").join(held.withColumn("held", F.coalesce("held", F.lit(0))), "shard")
    parts = rows.groupBy("shard").applyInArrow(shard_parts, PARTS)
    return parts.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns = stage(turns_of(conversations), "trie_marks")
    convs = stage(turns.groupBy("conv_id").agg(F.count("*").alias("own_turns")).select("conv_id"), "trie_convs")
    visits = stage(visits_of(turns, convs), "trie_visits")
    whole = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("first")).first()

    nodes = stage(
        visits.groupBy(*KEY).agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("first_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.max("chars").alias("chars")
        ),
        "trie_nodes",
    )
    seen = stage(visits.select("conv_id", *KEY).join(nodes.select(*KEY, "n_convs", "first_id", "chars"), KEY), "trie_seen")
    zero = F.lit(0).cast("long")
    root = F.struct(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(whole.first).cast("long").alias("first_id"))
    shared = F.col("n_convs") > 1
    spans = seen.groupBy("conv_id").agg(
        F.max("depth").alias("turns"), F.max_by(F.struct(*KEY, "first_id"), F.when(shared, F.col("depth"))).alias("last"), F.max(F.when(shared, F.col("depth"))).alias("common")
    )
    spans = convs.join(spans, "conv_id", "left").select(
        "conv_id", F.coalesce("turns", zero).alias("turns"), F.coalesce("common", zero).alias("common"), F.when(F.col("common").isNotNull(), F.col("last")).otherwise(root).alias("last")
    )
    spans = stage(spans.select("conv_id", "turns", "common", "last.*"), "trie_spans")

    # nodes of one conversation
    own = seen.where(~shared).select("conv_id", F.col("depth").alias("d")).join(spans, "conv_id")
    ending = F.col("d") == F.col("turns")
    tails = own.select(
        "conv_id",
        F.col("d").alias("depth"),
        F.when(F.col("d") - 1 > F.col("common"), F.col("conv_id")).otherwise(F.col("first_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"),
        F.when(ending, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.sha2(F.when(ending, F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256).alias("ends_sha256"),
    )

    # shared nodes and the root
    top = convs.sparkSession.range(1).where(F.lit(whole.n > 0)).select(
        *[zero.alias(c) for c in KEY], F.lit(whole.n).alias("n_convs"), F.lit(whole.first).cast("long").alias("first_id"),
        *[F.lit(None).cast("long").alias(c) for c in ("p1", "p2")], zero.alias("chars"),
    )
    common = nodes.where(shared).unionByName(top)
    inner = nodes.where(shared).groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("inner"))
    stops = spans.groupBy(*KEY).agg(F.sum((F.col("turns") > F.col("common")).cast("long")).alias("alone"), F.min("conv_id").alias("conv_id"))
    stops = stage(stops.join(inner, KEY, "left"), "trie_stops")

    steps = seen.where(shared).select("conv_id", *KEY, ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    steps = steps.join(stops.select("conv_id"), "conv_id", "left_semi")
    steps = steps.unionByName(stops.select("conv_id", *[zero.alias(c) for c in (*KEY, "own")]))
    paths = steps.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "own"))).alias("path"))
    ends = stops.select("conv_id", "alone", F.col("inner").isNotNull().alias("inner"))
    paths = paths.join(ends, "conv_id").select("alone", "inner", *[F.col(f"path.{c}").alias(c) for c in ("k1", "k2", "own")])
    paths = stage(paths, "trie_paths")
    sums = subtree_sums(paths, paths.agg(F.sum(F.size("k1"))).first()[0] or 0)

    ending = spans.where("turns = common").select(*KEY, "conv_id")
    texts = ending.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(joined_ids, CHUNKS)
    hashes = texts.repartition(*KEY).sortWithinPartitions(*KEY, "first_id").mapInArrow(hashed_ids, HASHES)

    parents = common.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("first_id").alias("above"))
    joined = common.join(sums, KEY).join(inner, KEY, "left").join(stops.select(*KEY, "alone"), KEY, "left").join(hashes, KEY, "left")
    joined = joined.join(parents.where("depth > 1"), ["depth", "p1", "p2"], "left")
    branches = joined.select(
        F.col("first_id").alias("conv_id"),
        "depth",
        F.when(F.col("depth") == 1, F.lit(whole.first)).otherwise(F.col("above")).cast("long").alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("inner", zero) + F.coalesce("alone", zero)).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return branches.unionByName(tails)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
