"""Embedding whitening over distributed block matrices.

Centred rows get a dense index and become a ``BlockMatrix``; its transpose times
itself is the scatter, whose eigenvectors (width x width, on the driver) make
the whitening matrix; the blocks times that matrix are the whitened rows.

Defined results: vectors that are null or hold null or non-finite entries, or
entries whose scaled value has no long, give no rows. Repeated rows count and
appear as often as they occur, null ids too. Vectors shorter than the longest
are filled with 0.0; empty tables and tables of empty vectors give no rows. A
component without variance has null ``whitened`` and, if no component has any,
null ``explained``. ``deviation`` is null where it has no long. Other columns
are left out.

Bounds: a block holds ``BLOCK_CELLS`` doubles, a multiplying task ``MIDDLE``
blocks a side; the driver holds one scatter of the vectors' width squared and
the coordinates of the blocks (rows / 4,096 at 64 dimensions).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringweave.llm.common import table
from ringweave.session import stage

SCALE, SHIFT = 1024, 100_000
#: scaled entries from here on have no long
WIDEST = 9.2e18
COMPONENTS = 8
BLOCK_CELLS = 1 << 18
MOST_COLUMNS = 1024
#: blocks of each side that one task of the scatter multiplies
MIDDLE = 8
#: variances below this share of the largest are rounding
NO_VARIANCE = 1e-12

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of the vectors that take part."""
    entries = F.transform("embedding", lambda c: c.cast("double") * SCALE)
    good = vectors.select("vec_id", entries.alias("e")).where(
        F.col("e").isNotNull() & F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < WIDEST))
    )
    return good.select("vec_id", F.transform("e", lambda c: F.floor(c) + SHIFT).alias("x"))


def indexed(rows: DataFrame, width: int) -> DataFrame:
    """Rows of one width with a dense index; a written table, so the index holds."""
    filled = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))
    placed = stage(rows.select("vec_id", filled.alias("x"), F.monotonically_increasing_id().alias("at")), "whitening_rows")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("part").agg(F.count("*").alias("k"))  # one row a writing task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select(
        (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("row"), "vec_id", "x"
    )


def as_blocks(rows: DataFrame, means: list[float]) -> BlockMatrix:
    """Centred rows as blocks."""
    width = len(means)
    columns = min(width, MOST_COLUMNS)
    centred = F.zip_with("x", F.array(*map(F.lit, means)), lambda x, m: x.cast("double") - m)
    frame = rows.select("row", array_to_vector(centred).alias("v"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(frame, "v")).toBlockMatrix(BLOCK_CELLS // columns, columns)


def product(left: BlockMatrix, right: BlockMatrix, middle_splits: int = 1) -> BlockMatrix:
    """``left x right``; a long middle dimension is multiplied in that many tasks and their sums added."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, middle_splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def components_of(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling variances and unit components (columns), their largest entry positive."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1].clip(0), vectors[:, ::-1]
    lead = vectors[np.abs(vectors).argmax(0), np.arange(len(values))]
    return values, vectors * np.where(lead < 0, -1.0, 1.0)


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows of ``OUT``: the leading whitened coordinates of every usable vector."""
    spark = vectors.sparkSession
    kept = scaled(vectors)
    width = kept.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return spark.createDataFrame([], OUT)
    rows = indexed(kept, width)
    # one row a dimension; exact, as decimals have room for any sum of longs
    sums = rows.select(F.posexplode("x").alias("d", "v")).groupBy("d").agg(F.sum(F.col("v").cast("decimal(19,0)")).alias("s"), F.count("*").alias("n"))
    totals = sums.orderBy("d").collect()
    n, s = totals[0].n, [int(r.s) for r in totals]

    blocks = as_blocks(rows, [v / n for v in s])
    scatter = product(blocks.transpose(), blocks, math.ceil(blocks.numRowBlocks / MIDDLE)).toLocalMatrix().toArray()
    values, axes = components_of(scatter / n)
    shown = min(components, width)
    live = values[:shown] > values[0] * NO_VARIANCE
    matrix = np.where(live, axes[:, :shown] / np.sqrt(np.where(live, values[:shown], 1)), 0.0)

    step = blocks.colsPerBlock
    pieces = [((i // step, 0), DenseMatrix(len(m), shown, m.ravel(order="F").tolist())) for i, m in ((i, matrix[i : i + step]) for i in range(0, width, step))]
    into = BlockMatrix(spark.sparkContext.parallelize(pieces, 1), step, shown, width, shown)
    lines = callMLlibFunc("getIndexedRows", product(blocks, into).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    projected = stage(lines.select(F.col("index").alias("row"), vector_to_array("vector").alias("w")), "whitened")

    at = [F.get("w", F.lit(i)) for i in range(shown) if live[i]]
    off = [F.abs(F.covar_pop(a, b) - (1.0 if i == j else 0.0)) for i, a in enumerate(at) for j, b in enumerate(at[: i + 1])]
    error = projected.agg(F.greatest(F.lit(0.0), *off).alias("e")).first().e if off else None

    trace = float(values.sum())
    facts = [(i + 1, bool(live[i]), float(values[i]) / trace if trace else None) for i in range(shown)]
    parts = F.array(*[F.struct(F.lit(i).alias("component"), F.lit(ok).alias("live"), F.lit(e).cast("double").alias("explained")) for i, ok, e in facts])
    if max(map(abs, s)) < WIDEST:
        own = F.array(*[F.lit(v) for v in s])
        gap = rows.withColumn("gaps", F.zip_with("x", own.cast("array<bigint>"), lambda x, t: F.try_subtract(F.try_multiply(x, F.lit(n).cast("long")), t)))
        square = F.aggregate("gaps", F.lit(0).cast("long"), lambda t, d: F.try_add(t, F.try_multiply(d, d)))
    else:
        gap, square = rows, F.lit(None).cast("long")
    measured = gap.select("row", "vec_id", square.alias("deviation"))
    long_rows = measured.join(projected, "row").select("vec_id", "deviation", F.explode(F.arrays_zip(parts.alias("p"), F.col("w").alias("w"))).alias("c"))
    return long_rows.select(
        "vec_id",
        F.col("c.p.component").cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("c.p.live"), F.col("c.w")).alias("whitened"),
        F.col("c.p.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
