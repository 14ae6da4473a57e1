"""Near copies among embeddings by int8 tile products with error bounds.

Distinct vectors are scaled to unit length and quantised to int8 with a scale
of their own; the norm of what rounding leaves is kept. For two vectors
``x = a*p + r`` and ``y = b*q + s`` (``p``, ``q`` int8) the error of ``a*b*(p.q)`` is at most
``|r| + |s| + |r|*|s|`` as unit vectors have norm 1 (rounding of the arithmetic itself is
allowed for). Integer products of tiles are exact in float32 for up to 1040 dimensions.
Only pairs whose upper bound reaches the threshold are recomputed in double
precision from the original vectors.

Vectors are dealt to bands of bounded size; each pair of bands is one task.
A task returns, for each of its vectors, the number of linked rows and one link
that joins it to its group inside the task, so what is written
grows with vectors and bands, never with pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.llm.common import components, table
from ringweave.session import stage

THRESHOLD = 0.9
BAND = 8192  # vectors of one band, about
TILE = 1024
EXACT_TERMS = (1 << 24) // (127 * 127)  # products that float32 adds up exactly


def usable(vector: str = "embedding"):
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def distinct_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Written table ``node, embedding, copies, least`` of the usable distinct vectors."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding")).where(usable())
    own = rows.groupBy("embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    return stage(own.select(F.monotonically_increasing_id().alias("node"), "embedding", "copies", "least"), "vectors")


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scales and remainder norms of unit vectors."""
    scale = np.abs(x).max(1) / 127.0
    codes = np.rint(x / scale[:, None])
    rest = np.linalg.norm(x - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, rest


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with the same row of ``y``, in double precision; scaled first so nothing overflows."""
    x, y = x / np.abs(x).max(1)[:, None], y / np.abs(y).max(1)[:, None]
    dot = np.einsum("ij,ij->i", x, y)
    return dot / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


class Band:
    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray) -> None:
        self.nodes, self.copies, self.vectors = nodes, copies, vectors
        scaled = vectors / np.abs(vectors).max(1)[:, None]
        unit = scaled / np.linalg.norm(scaled, axis=1)[:, None]
        self.codes, self.scale, self.rest = quantise(unit)


def near_pairs(a: Band, b: Band, same: bool, threshold: float = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked pairs, tile by tile; in one band each pair once."""
    exact = a.codes.shape[1] <= EXACT_TERMS
    kind = np.float32 if exact else np.float64
    slack = 1e-6 + 4e-16 * a.codes.shape[1]
    right = b.codes.astype(kind)
    for lo in range(0, len(a.nodes), TILE):
        left = a.codes[lo : lo + TILE].astype(kind)
        for at in range(lo if same else 0, len(b.nodes), TILE):
            product = left @ right[at : at + TILE].T
            # product * scales + error >= threshold, with the scales moved to the other side
            sa, ra = a.scale[lo : lo + TILE, None], a.rest[lo : lo + TILE, None]
            sb, rb = b.scale[None, at : at + TILE], b.rest[None, at : at + TILE]
            # one cheap test with the tile's largest error, then the pair's own bound
            worst = float(ra.max() + rb.max() + ra.max() * rb.max())
            i, j = np.nonzero(product * sa.astype(kind) >= ((threshold - worst - 1e-4) / sb).astype(kind))
            if same and at == lo:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            pair = ra[i, 0] + rb[0, j] + ra[i, 0] * rb[0, j]
            maybe = product[i, j].astype(np.float64) * sa[i, 0] * sb[0, j] + pair + slack >= threshold
            i, j = i[maybe] + lo, j[maybe] + at
            for cut in range(0, len(i), 1 << 16):
                p, q = i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]
                linked = cosines(a.vectors[p], b.vectors[q]) >= threshold
                yield p[linked], q[linked]


class Forest:
    """Groups of positions, joined link by link."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while ((again := self.root[self.root]) != self.root).any():
                self.root = again


def compare(a: Band, b: Band | None, threshold: float = THRESHOLD) -> pa.RecordBatch:
    """Linked rows of each vector that has any, and a vector of the task it is joined to."""
    same = b is None
    b = a if same else b
    shift = 0 if same else len(a.nodes)
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    copies = a.copies if same else np.concatenate([a.copies, b.copies])
    links, forest = np.zeros(len(nodes), np.int64), Forest(len(nodes))
    for i, j in near_pairs(a, b, same, threshold):
        j = j + shift
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        forest.join(i, j)
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(links[some]), pa.array(nodes[forest.root[some]])], ["node", "links", "other"])


def task_links(vectors: DataFrame, threshold: float = THRESHOLD, band: int = BAND) -> DataFrame:
    """``node, links, other`` of every pair of bands."""
    bands = max(1, -(-vectors.count() // band))
    own = F.pmod(F.xxhash64("node"), F.lit(bands))
    other = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    dealt = vectors.select("node", "copies", "embedding", own.alias("band"), other.alias("with"))
    dealt = dealt.select(F.least("band", "with").alias("low"), F.greatest("band", "with").alias("high"), "band", "node", "copies", "embedding")

    def run(keys, found):
        low, high = (k.as_py() for k in keys)
        flat = found.column("embedding").combine_chunks()
        sizes = np.diff(flat.offsets.to_numpy())
        out = []
        # vectors of different length never link
        for size in np.unique(sizes).tolist():
            rows = found.filter(pa.array(sizes == size))
            which = rows.column("band").to_numpy()
            values = np.stack(rows.column("embedding").to_numpy())
            nodes, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
            sides = [Band(nodes[at], copies[at], values[at]) for side in ([low] if low == high else [low, high]) if len(at := np.flatnonzero(which == side))]
            if low == high and sides:
                out.append(compare(sides[0], None, threshold))
            elif len(sides) == 2:
                out.append(compare(sides[0], sides[1], threshold))
        return pa.Table.from_batches(out, pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]))

    return dealt.groupBy("low", "high").applyInArrow(run, "node bigint, links bigint, other bigint")


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, band: int = BAND, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing: they have 0 links and themselves as component. Equal rows
    link with each other. A null id stays null in a component of its own; the
    component of a group is its smallest id. Other columns are left out.
    """
    vectors = distinct_vectors(df, id_col, vector_col)
    tasks = stage(task_links(vectors, threshold, band), "links")
    counts = tasks.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(tasks.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    own = vectors.select(F.col("node").alias("n"), "embedding", "copies", "least")
    joined = own.join(counts, own.n == counts.node, "left").drop("node").join(root, F.col("n") == root.node, "left")
    joined = stage(joined.select("embedding", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "n").alias("root")), "joined")
    least = joined.groupBy("root").agg(F.min("least").alias("component"))
    known = joined.join(least, "root").select(F.col("embedding").alias("e"), "n_links", "component")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("embedding", F.when(usable(), F.col("embedding")))
    out = rows.join(known, rows.embedding == known.e, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
