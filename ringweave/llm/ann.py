"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast Hadamard pseudo-rotations (random signs and a
Walsh-Hadamard transform, three times over) and gets the nearest signed axis. The
number of axes, and of rotations joined into one key, follows the number of
vectors, so a bucket holds about BUCKET of them at any size. Several tables
with rotations of their own are kept; a query looks into its nearest buckets
of each and every candidate is ranked by its exact distance.

A fixed number of buckets is an ever smaller share of a growing table. So the
true neighbours of SAMPLE queries a vector length, chosen by a hash over all,
are found by comparison with all rows, and tables and probes grow from TABLES and
PROBES until RECALL of them lie in probed buckets, by two standard errors. Where that
would take as many comparisons as there are rows, as on small tables, queries probe
every key of one table and so find all.

Rows of one vector are one entry of the index, which keeps the smallest ids: no
answer can need more. Buckets with many entries or queries are cut into blocks, and
each block gives a query its best entries only. Queries that find too few
candidates, too, are compared with all vectors in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringweave.llm.common import table
from ringweave.llm.vector_dedup import usable
from ringweave.session import stage

TABLES, PROBES, BUCKET = 8, 8, 512  # the least tables times probes, and entries a bucket
RECALL, SAMPLE, MOST_TABLES, MOST_PROBES = 0.9, 256, 32, 4096
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
SEED = 10


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, orthonormal; the width is a power of two."""
    rows, width = x.shape
    half = 1
    while half < width:
        pairs = x.reshape(rows, -1, 2, half)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], axis=2).reshape(rows, width)
        half *= 2
    return x / math.sqrt(width)


def axes_for(n: int, width: int, bucket: int = BUCKET) -> list[int]:
    """Axes of each joined rotation: together about ``n / bucket`` keys, at most ``2 * width`` each."""
    wanted, out = max(1.0, n / bucket), []
    while wanted > 1 or not out:
        axes = min(width, max(1, math.ceil(min(wanted, 2.0 * width) / 2)))
        out.append(axes)
        wanted /= 2 * axes
    return out


def turned(x: np.ndarray, turn: int, part: int, axes: int, seed: int = SEED) -> np.ndarray:
    """Signed coordinates (``2 * axes`` columns) of unit vectors under one pseudo-rotation."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    random = np.random.default_rng([seed, turn, part, width])
    for _ in range(3):
        x = hadamard(x * random.choice([-1.0, 1.0], width))
    return np.concatenate([x[:, :axes], -x[:, :axes]], axis=1)


def keys_of(x: np.ndarray, turn: int, axes: list[int], probes: int, seed: int = SEED) -> np.ndarray:
    """``[rows, probes]`` bucket keys, nearest first: those with the largest sum of signed coordinates; -1 where there are fewer."""
    sums, keys = np.zeros((len(x), 1)), np.zeros((len(x), 1), np.int64)
    for part, n in enumerate(axes):
        coords = turned(x, turn, part, n, seed)
        best = np.argsort(-coords, axis=1, kind="stable")[:, :probes]
        value = np.take_along_axis(coords, best, 1)
        sums = (sums[:, :, None] + value[:, None, :]).reshape(len(x), -1)
        keys = (keys[:, :, None] * (2 * n) + best[:, None, :]).reshape(len(x), -1)
        order = np.argsort(-sums, axis=1, kind="stable")[:, :probes]
        sums, keys = np.take_along_axis(sums, order, 1), np.take_along_axis(keys, order, 1)
    return keys


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def matrices(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Positions and matrix of the vectors of each length."""
    rows = column.to_pylist()
    sizes = np.array([len(r) for r in rows])
    return [(at, np.array([rows[i] for i in at], np.float64)) for s in np.unique(sizes) for at in [np.flatnonzero(sizes == s)]]


def index_entries(df: DataFrame, most: int, id_col: str, vector_col: str) -> DataFrame:
    """Written table ``node, embedding, ids``: distinct usable vectors with their ``most`` smallest ids (nulls last)."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding")).where(usable())
    order = Window.partitionBy("embedding").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    own = few.groupBy("embedding").agg(F.sort_array(F.collect_list(F.struct("n", "id"))).alias("ids"))
    return stage(own.select(F.monotonically_increasing_id().alias("node"), "embedding", "ids"), "entries")


def width_of(size: int) -> int:
    return 1 << max(0, size - 1).bit_length()


def codes(entries: DataFrame, n: int, plan: dict[int, tuple[int, int]]) -> DataFrame:
    """``side, node, turn, bucket``: where entries lie (side 0) and where query entries look (side 1).

    ``plan`` has the tables and probes of each length of vectors; others have no rows.
    """

    def rows(side: int, node: np.ndarray, turn: int, size: int, bucket: np.ndarray) -> pa.RecordBatch:
        columns = (np.full(len(node), side), node, np.full(len(node), turn), np.full(len(node), size), bucket)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["side", "node", "turn", "size", "bucket"])

    def run(batches):
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            nodes = batch.column("node").to_numpy()
            for at, x in matrices(batch.column("embedding")):
                if x.shape[1] not in plan:
                    continue
                (tables, probes), u, axes = plan[x.shape[1]], unit(x), axes_for(n, width_of(x.shape[1]))
                asking = np.flatnonzero(asks[at])
                step = max(1, (1 << 22) // (probes * 2 * max(axes)))
                for turn in range(tables):
                    yield rows(0, nodes[at], turn, x.shape[1], keys_of(u, turn, axes, 1)[:, 0])
                    for lo in range(0, len(asking), step):
                        some = asking[lo : lo + step]
                        keys = keys_of(u[some], turn, axes, probes)
                        yield rows(1, np.repeat(nodes[at][some], keys.shape[1]), turn, x.shape[1], keys.ravel())

    return entries.select("node", "embedding", "asks").mapInArrow(run, "side bigint, node bigint, turn bigint, size bigint, bucket bigint")


def true_neighbours(marked: DataFrame, k: int, sample: int) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """By length of vectors: up to ``sample`` asking entries, chosen by a hash over all, each with the matrix of its ``k`` nearest entries."""
    order = Window.partitionBy("size").orderBy(F.xxhash64("embedding"), "node")
    asking = marked.where("asks").select("node", "embedding", F.size("embedding").alias("size"))
    chosen = asking.withColumn("place", F.row_number().over(order)).where(F.col("place") <= sample).collect()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {r["size"] for r in chosen}:
        own = [r for r in chosen if r["size"] == size]
        by_size[size] = np.array([r["node"] for r in own]), np.array([r["embedding"] for r in own], np.float64)

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            for at, x in matrices(batch.column("embedding")):
                if x.shape[1] in by_size:
                    found.setdefault(x.shape[1], []).append(nearest_in_block(x, nodes[at], by_size[x.shape[1]][1], k + 1))
        for size, some in found.items():
            i, node, away = (np.concatenate(c) for c in zip(*some, strict=True))
            order = np.lexsort((node, away, i))
            i, node, away = i[order], node[order], away[order]
            near = np.arange(len(i)) - np.searchsorted(i, i) <= k
            yield pa.RecordBatch.from_arrays([pa.array(by_size[size][0][i[near]]), pa.array(node[near]), pa.array(away[near])], ["asker", "m", "away"])

    hits = marked.select("node", "embedding").mapInArrow(run, "asker bigint, m bigint, away double").where(F.col("asker") != F.col("m"))
    order = Window.partitionBy("asker").orderBy("away", "m")
    best = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("asker", "m")
    near: dict[int, list] = {}
    for r in best.join(marked.select(F.col("node").alias("m"), "embedding"), "m").select("asker", "embedding").collect():
        near.setdefault(r["asker"], []).append(r["embedding"])
    return {
        size: [(x, np.array(near[node], np.float64)) for node, x in zip(nodes.tolist(), xs, strict=True) if node in near]
        for size, (nodes, xs) in by_size.items()
    }


def places(asked: np.ndarray, near: np.ndarray, owner: np.ndarray, turn: int, axes: list[int]) -> np.ndarray:
    """How many buckets of one table the query ``asked[owner]`` of each row of ``near`` probes before that row's."""
    u, v = unit(asked), unit(near)
    coords = [(turned(u, turn, part, n), turned(v, turn, part, n).argmax(1)) for part, n in enumerate(axes)]
    own = sum(c[owner, key] for c, key in coords)
    out = np.zeros(len(near), np.int64)
    for i in range(len(asked)):
        sums, mine = np.zeros(1), owner == i
        for c, _ in coords:
            sums = (sums[:, None] + c[i]).ravel()
        sums.sort()
        out[mine] = np.maximum(len(sums) - np.searchsorted(sums, own[mine] - 1e-12) - 1, 0)
    return out


def calibrated(pairs: list[tuple[np.ndarray, np.ndarray]], n: int, tables: int, probes: int, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int] | None:
    """Tables and probes of the least product, ``tables * probes`` at least, that find ``recall`` of the true neighbours.

    ``pairs`` are queries and their true neighbours among ``n`` entries. The mean over
    queries has to exceed ``recall`` by two standard errors. Where that takes as many
    comparisons as there are entries, all keys of one table are probed, which finds
    every entry. None: those are more than ``MOST_PROBES``.
    """
    if not pairs:
        return tables, probes
    asked, near = np.array([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])
    owner = np.repeat(np.arange(len(pairs)), [len(y) for _, y in pairs])
    axes = axes_for(n, width_of(asked.shape[1]), bucket)
    keys, sizes = math.prod(2 * a for a in axes), np.bincount(owner)
    most = max(MOST_TABLES, tables)
    best = np.minimum.accumulate([places(asked, near, owner, turn, axes) for turn in range(most)])

    def enough(count: int, looks: int) -> bool:
        own = np.bincount(owner, best[count - 1] < looks) / sizes
        return own.mean() - 2 * own.std() / math.sqrt(len(own)) >= recall

    if tables * probes * bucket < n and enough(tables, probes):
        return tables, probes
    found = None
    for count in sorted({tables, most, *(1 << i for i in range(most.bit_length()))}):
        looks = -(-tables * probes // count)
        while count * looks * bucket < n and (found is None or count * looks < found[0]):
            if enough(count, looks):
                found = count * looks, count, min(looks, keys)
                break
            looks = max(looks + 1, int(looks * 1.1))
    if found:
        return found[1:]
    return (1, keys) if keys <= MOST_PROBES else None


def nearest_in_block(x: np.ndarray, nodes: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``y`` the ``most`` nearest rows of ``x`` (all that tie with the last): query position, node, exact distance."""
    scale = 2.0 ** np.ceil(np.log2(max(np.abs(x).max(), np.abs(y).max())))  # a power of two: exact
    x, y = x / scale, y / scale
    xx, out = np.einsum("ij,ij->i", x, x), []  # differences are scaled again, pair by pair, so that none underflows
    for lo in range(0, len(y), 256):
        part = y[lo : lo + 256]
        rough = xx[None, :] - 2 * (part @ x.T)
        if len(x) > most:
            edge = np.partition(rough, most - 1, axis=1)[:, most - 1]
            i, j = np.nonzero(rough <= (edge + 1e-12 * (1 + xx.max()))[:, None])
        else:
            i, j = np.divmod(np.arange(len(part) * len(x)), len(x))
        apart = part[i] - x[j]
        most_apart = np.abs(apart).max(1)
        own = 2.0 ** np.ceil(np.log2(np.where(most_apart > 0, most_apart, 1.0)))
        away = np.sqrt(((apart / own[:, None]) ** 2).sum(1)) * own * scale
        order = np.lexsort((away, i))
        i, j, away = i[order], j[order], away[order]
        first = np.searchsorted(i, i)
        last = np.minimum(first + most - 1, len(i) - 1)
        near = (np.arange(len(i)) - first < most) | ((i[last] == i) & (away <= away[last]))
        out.append((i[near] + lo, nodes[j[near]], away[near]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def search_blocks(placed: DataFrame, entries: DataFrame, most: int, block_rows: int | None = None) -> DataFrame:
    """``asker, node, away``: the nearest entries of each block of each bucket."""
    keys = ["turn", "size", "bucket"]
    sizes = placed.groupBy(*keys).agg(F.sum(1 - F.col("side")).alias("rows"), F.sum("side").alias("asking"))
    sizes = stage(sizes.where("rows > 0 AND asking > 0").select(
        *[F.col(k).alias(f"k_{k}") for k in keys],
        F.ceil(F.col("rows") / (block_rows or BLOCK_ROWS)).cast("int").alias("row_cuts"),
        F.ceil(F.col("asking") / BLOCK_QUERIES).cast("int").alias("ask_cuts"),
    ), "buckets")
    cut = placed.join(sizes, [F.col(k) == F.col(f"k_{k}") for k in keys])
    spot = F.xxhash64("node", "turn")
    own = F.when(F.col("side") == 0, F.pmod(spot, "row_cuts")).otherwise(F.pmod(spot, "ask_cuts"))
    other = F.when(F.col("side") == 0, F.col("ask_cuts")).otherwise(F.col("row_cuts"))
    cut = cut.select("side", F.col("node").alias("n"), *keys, own.alias("own"), F.explode(F.sequence(F.lit(0), other - 1)).alias("other"))
    cut = cut.withColumn("row_cut", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")))
    cut = cut.withColumn("ask_cut", F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")))
    full = cut.join(entries.select("node", "embedding"), F.col("n") == F.col("node")).select("side", "node", "embedding", *keys, "row_cut", "ask_cut")

    def run(key, found):
        side = found.column("side").to_numpy()
        rows, asking = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        empty = pa.schema([("asker", pa.int64()), ("node", pa.int64()), ("away", pa.float64())]).empty_table()
        if not len(rows) or not len(asking):
            return empty
        (_, x), nodes = matrices(found.column("embedding"))[0], found.column("node").to_numpy()
        i, node, away = nearest_in_block(x[rows], nodes[rows], x[asking], most)
        return pa.table({"asker": nodes[asking][i], "node": node, "away": away})

    return full.groupBy(*keys, "row_cut", "ask_cut").applyInArrow(run, "asker bigint, node bigint, away double")


def neighbours(
    df: DataFrame,
    asked: DataFrame,
    k: int = 10,
    tables: int = TABLES,
    probes: int = PROBES,
    bucket: int = BUCKET,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``asked`` (rows of ``df``) its ``k`` nearest found rows of ``df`` but itself.

    Distance is Euclidean in double precision; ties go to the smaller id, null
    ids last. Vectors that are null, empty, zero or hold null or non-finite
    components take no part, vectors of different lengths never meet. Repeated rows
    are rows of their own. Other columns are left out. ``tables * probes`` is where the
    search for ``recall`` starts.
    """
    entries = index_entries(df, k + 1, id_col, vector_col)
    rows = asked.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("embedding")).where(usable())
    own = entries.select(F.col("embedding").alias("e"), "node")
    same = Window.partitionBy("node", "query_id").orderBy(F.lit(1))
    queries = rows.join(own, rows.embedding == own.e).withColumn("turn_of_id", F.row_number().over(same))
    queries = stage(queries.select(F.monotonically_increasing_id().alias("q"), "query_id", "turn_of_id", "node"), "queries")
    askers = queries.select(F.col("node").alias("a")).distinct()
    marked = stage(entries.join(askers, entries.node == askers.a, "left").select("node", "embedding", F.col("a").isNotNull().alias("asks")), "marked")
    n = marked.count()
    plan = {size: calibrated(pairs, n, tables, probes, recall, bucket) for size, pairs in true_neighbours(marked, k, SAMPLE).items()}
    # the number of entries over BUCKET sets the number of keys
    placed = stage(codes(marked, n * BUCKET // bucket, {size: p for size, p in plan.items() if p}), "codes")
    hits = search_blocks(placed, entries, k + 1)
    best = stage(_best(hits, k), "hits")
    out = _answers(best, queries, entries, k)
    available = F.size("embedding")
    per_size = stage(entries.groupBy(available.alias("size")).agg(F.sum(F.size("ids")).alias("rows")), "sizes")
    # exact search for those without a plan and those that found fewer than k though there are more
    got = out.groupBy("q").agg(F.count(F.lit(1)).alias("got"))
    with_size = queries.join(entries.select(F.col("node").alias("m"), available.alias("size")), F.col("node") == F.col("m")).join(per_size, "size")
    short = with_size.join(got, "q", "left").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("rows") - 1)).select("node", "size").distinct()
    short = stage(short, "short")
    if short.limit(1).count():
        everything = entries.select(F.lit(0).cast("long").alias("side"), "node", F.lit(-1).cast("long").alias("turn"), available.cast("long").alias("size"), F.lit(0).cast("long").alias("bucket"))
        asking = short.select(F.lit(1).cast("long").alias("side"), "node", F.lit(-1).cast("long").alias("turn"), F.col("size").cast("long"), F.lit(0).cast("long").alias("bucket"))
        more = search_blocks(everything.union(asking), entries, k + 1, min(BLOCK_ROWS, max(BUCKET, n // 64)))
        best = stage(_best(best.select("asker", "node", "away").union(more), k), "hits")
        out = _answers(best, queries, entries, k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The nearest entries of each asking entry: ``k + 1`` and all that tie with the last."""
    once = hits.groupBy("asker", "node").agg(F.min("away").alias("away"))
    order = Window.partitionBy("asker").orderBy("away")
    return once.withColumn("place", F.rank().over(order)).where(F.col("place") <= k + 1)


def _answers(best: DataFrame, queries: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    ids = entries.select(F.col("node").alias("m"), F.explode("ids").alias("one")).select("m", F.col("one.n").alias("n"), F.col("one.id").alias("vec_id"))
    occurrence = ids.withColumn("nth", F.row_number().over(Window.partitionBy("m", "vec_id").orderBy("n")))
    found = best.join(occurrence, best.node == occurrence.m).select("asker", "away", "m", "vec_id", "nth")
    pairs = queries.join(found, queries.node == found.asker)
    itself = (F.col("node") == F.col("m")) & F.col("query_id").eqNullSafe(F.col("vec_id")) & (F.col("turn_of_id") == F.col("nth"))
    order = Window.partitionBy("q").orderBy("away", F.col("vec_id").asc_nulls_last(), "nth")
    ranked = pairs.where(~itself).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("q", "query_id", "rank", "vec_id", F.col("away").alias("score"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.where(F.col("vec_id") % 100 == 0))
