"""Whitening of embeddings on distributed block matrices.

Entries become integers, so that sums and deviations are exact.  Rows are numbered, centred and laid out in
blocks of a BlockMatrix; its transpose times itself is the scatter, whose eigenvectors are found on the
driver; and the matrix times the whitening matrix projects all rows.  The driver holds what has the size of
a scatter, and a pair of numbers for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.joins import stage

#: Rows and columns of a block.
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024
#: Blocks that one task multiplies and adds up.
BLOCKS_A_TASK = 8
#: An entry c becomes floor(SCALE * c) + SHIFT; entries whose integer has more than 53 bits are not finite here.
SCALE, SHIFT = 1024, 100_000
#: Components whose variance is less than this share of the largest have none.
LEAST_VARIANCE = 1e-12


@dataclass
class Whitening:
    """``vectors`` has a column for each component, by falling ``variances``; ``total`` is the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.variances)


def valid(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """``id`` and integer entries ``x`` of rows that take part."""
    found = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    known = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float(1 << 53)))
    x = F.transform("vector", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return found.filter(known & (F.size("vector") > 0)).select("id", x.alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with their places: ``part`` and ``place`` in it, kept in a table and never made again."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stage(rows.select("id", "x", F.spark_partition_id().alias("part"), place.alias("place")))


def sums_of(rows: DataFrame, dimensions: int) -> list[int]:
    """Exact sums of each entry, from those of its upper and lower bits."""
    entries = rows.select(F.posexplode("x").alias("i", "x"))
    halves = entries.groupBy("i").agg(F.sum(F.shiftright("x", 26)).alias("high"), F.sum(F.col("x").bitwiseAND(F.lit((1 << 26) - 1))).alias("low"))
    found = {r.i: (r.high << 26) + r.low for r in halves.collect()}
    return [found[i] for i in range(dimensions)]


_BLOCK = "block int, ids array<long>, deviations array<decimal(38,0)>, centred binary"


def _centred(table: pa.Table, n: int, sums: list[int]) -> pa.Table:
    """One block: ids, exact sums of squares of ``n * x - sums``, and centred rows, column after column."""
    table = table.sort_by("place")
    x = table.column("x").combine_chunks()
    x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    small = n * int(np.abs(x).max()) + max(map(abs, sums)) < 1 << 62
    kind = np.int64 if small else object
    apart = x.astype(kind) * n - np.array(sums, kind)
    largest = int(np.abs(apart).max())
    exact = apart if largest**2 * x.shape[1] < 1 << 62 else apart.astype(object)
    squares = (exact * exact).sum(axis=1)
    deviations = [Decimal(int(v)) if int(v) < 10**38 else None for v in squares]
    centred = (apart / n).astype(np.float64)
    return pa.table(
        {
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()),
            "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64())),
            "deviations": pa.array([deviations], pa.list_(pa.decimal128(38, 0))),
            "centred": pa.array([centred.T.tobytes()], pa.binary()),
        }
    )


def centred_blocks(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """A row for each ``BLOCK_ROWS`` rows, numbered through all parts."""
    spark = rows.sparkSession
    parts = sorted(rows.groupBy("part").count().collect())  # a row per task that wrote
    offsets = np.cumsum([0, *(r["count"] for r in parts)])
    starts = spark.createDataFrame([(r.part, int(o)) for r, o in zip(parts, offsets, strict=False)], "part int, start long")
    index = F.col("start") + F.col("place")
    placed = rows.join(F.broadcast(starts), "part").select("id", "x", index.alias("place"), (F.floor(index / BLOCK_ROWS)).cast("int").alias("block"))
    return stage(placed.groupBy("block").applyInArrow(lambda t: _centred(t, n, sums), _BLOCK))


def _entries(block: int, data: bytes, columns: int) -> Iterator[tuple[tuple[int, int], DenseMatrix]]:
    """The blocks of a matrix that a row of centred entries holds."""
    values = np.frombuffer(data, np.float64).reshape(columns, -1)
    for k in range(0, columns, BLOCK_COLUMNS):
        some = values[k : k + BLOCK_COLUMNS]
        yield (block, k // BLOCK_COLUMNS), DenseMatrix(some.shape[1], some.shape[0], some.ravel())


def block_matrix(blocks: DataFrame, n: int, columns: int) -> BlockMatrix:
    """The matrix of ``block`` and ``centred``."""
    entries: RDD = blocks.select("block", "centred").rdd.flatMap(lambda r: _entries(r.block, r.centred, columns))
    return BlockMatrix(entries, BLOCK_ROWS, BLOCK_COLUMNS, n, columns)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix.

    Its block row is as long as the matrix, so the products are added up by as many tasks as there are
    ``BLOCKS_A_TASK`` blocks, then once more; Python's ``multiply`` does not pass on that number.
    """
    blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, max(1, -(-blocks // BLOCKS_A_TASK)))
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def eigen(n: int, sums: list[int], covariance: np.ndarray, k: int) -> Whitening:
    """The ``k`` components of largest variance, fewer if less have any; of each vector the largest entry is positive."""
    variances, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-variances, kind="stable")[:k]
    order = order[variances[order] > max(variances.max(), 0) * LEAST_VARIANCE]
    vectors = vectors[:, order]
    largest = np.abs(vectors).argmax(axis=0)
    signs = np.where(vectors[largest, np.arange(len(order))] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors * signs, variances[order], float(np.trace(covariance)))


def projected(spark: SparkSession, matrix: BlockMatrix, whitening: Whitening) -> DataFrame:
    """``block`` and ``whitened``, its rows of as many values as there are components."""
    by, k = whitening.matrix, whitening.matrix.shape[1]
    pieces = [((i // BLOCK_COLUMNS, 0), DenseMatrix(len(some), k, some.T.ravel())) for i in range(0, len(by), BLOCK_COLUMNS) for some in (by[i : i + BLOCK_COLUMNS],)]
    product = matrix.multiply(BlockMatrix(spark.sparkContext.parallelize(pieces, 1), BLOCK_COLUMNS, k, len(by), k))
    rows = product.blocks.map(lambda b: (b[0][0], b[1].toArray().tolist()))
    return stage(spark.createDataFrame(rows, "block int, whitened array<array<double>>"))


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the covariance of whitened rows minus the identity."""

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += batch.column("whitened").flatten().flatten().to_numpy().reshape(-1, k).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(total)], ["i", "total"])

    found = {r.i: r.total for r in whitened.mapInArrow(totals, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()}
    mean = np.array([found[i] / n for i in range(k)])

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(np.array(w) - mean).T.tobytes() for w in batch.column("whitened").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(rows, pa.binary())], ["block", "centred"])

    around = block_matrix(whitened.mapInArrow(centred, "block int, centred binary"), n, k)
    return float(np.abs(scatter(around) / n - np.eye(k)).max())


def whiten(rows: DataFrame, k: int = 8, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each row's ``id``, ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    An entry c counts as x = floor(1024 c) + 100000; ``deviation`` is the exact sum of (n x - S) squared over
    the entries, with n rows and S their sums, null beyond 38 digits.  ``whitened`` is x - S / n projected on
    the component and divided by its standard deviation, ``explained`` the component's share of all variance,
    ``identity_error`` the largest absolute entry of the covariance of ``whitened`` minus the identity.

    Vectors that are null or empty, hold null or non-finite entries or such whose x has over 53 bits, or have
    another length than most (the longer of equally frequent ones) take no part.  Repeated rows each count;
    rows without id stay, with null.  Components without variance are left out, so equal vectors, a single one
    and empty tables give no rows.
    """
    spark = rows.sparkSession
    out = f"`{id}` long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = valid(rows, id, vector)
    most = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return spark.createDataFrame([], out)
    dimensions, n = most
    rows = numbered(rows.filter(F.size("x") == dimensions))
    sums = sums_of(rows, dimensions)
    blocks = centred_blocks(rows, n, sums)
    matrix = block_matrix(blocks, n, dimensions)
    whitening = eigen(n, sums, scatter(matrix) / n, k)
    k = len(whitening.variances)
    if not k:
        return spark.createDataFrame([], out)
    whitened = projected(spark, matrix, whitening)
    error = identity_error(whitened, n, k)
    each = blocks.select("block", "ids", "deviations").join(whitened, "block").select(F.inline(F.arrays_zip("ids", "deviations", "whitened")))
    each = each.select(F.col("ids").alias(id), F.col("deviations").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    explained = F.element_at(F.array(*(F.lit(float(v / whitening.total)) for v in whitening.variances)), F.col("i") + 1)
    return each.select(id, (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
