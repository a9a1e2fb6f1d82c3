"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are dealt to lists by their nearest centroid, and a query probes the lists of its nearest centroids.
Within a block of a list the vectors are rotated at random, so that any first dimensions are a fair sample
of all.  Squared distances are summed column block by column block, and after each a hypothesis test gives
up the candidates whose partial distance says that they are farther than the best found so far.  What
survives is measured exactly, in double precision, on the original vectors.

Centroids come from a bounded sample; every vector is in a list.  How many lists a query probes is measured on
the sample too: as many as hold the wanted share of the true neighbours there, but at least so many that
they have a fair number of vectors.  A query knows its distance to the kth nearest of the sample, which no
neighbour is beyond, so candidates are given up from the first block on.  A list of many vectors is cut
into blocks, and so a common vector into several; queries stream through a task that holds one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.joins import stage

#: Vectors that centroids are fitted on, about.
SAMPLE_ROWS = 8000
#: Lists are as many as the square root of the rows, but have so many vectors of the sample on average.
SAMPLED_A_LIST = 32
#: Share of the true neighbours, among the sample, that the probed lists must hold, and queries it is measured with.
RECALL, MEASURED = 0.95, 400
#: Vectors that the probed lists of a query hold at least, if there are so many.
LEAST_CANDIDATES = 2000
#: Bytes of the part of the sample that queries take their first bound from.
BOUND_BYTES = 16 << 20
#: Vectors of a list that are held together.
BLOCK_ROWS = 512
#: Dimensions summed between tests, and how far beyond its expectation a partial distance must be.
COLUMNS, EPSILON = 16, 2.1
ROUNDS = 8
_SEED = 20_240_229


@dataclass
class Index:
    """``probes`` lists are probed; ``sample`` are some of the rows, with their ``ids``."""

    dimensions: int
    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    sample: np.ndarray
    ids: np.ndarray

    def near(self, rows: np.ndarray) -> np.ndarray:
        """The lists of each row, nearest first."""
        return np.argsort((self.centroids**2).sum(axis=1) / 2 - rows @ self.centroids.T, axis=1, kind="stable")

    def bounds(self, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
        """Squared distances of each row to the ``k``-th nearest of the sample but those with its id."""
        if len(self.ids) < k:
            return np.full(len(rows), np.inf)
        near = (rows**2).sum(axis=1)[:, None] + (self.sample**2).sum(axis=1) - 2 * rows @ self.sample.T
        near[ids[:, None] == self.ids] = np.inf
        first = np.argpartition(near, k - 1, axis=1)[:, :k]
        exact = ((self.sample[first] - rows[:, None, :]) ** 2).sum(axis=2)  # products lose the last digits
        exact[np.take_along_axis(near, first, axis=1) == np.inf] = np.inf
        return exact.max(axis=1)


def valid(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """``id`` and ``vector`` in double precision of rows that take part."""
    found = rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return found.filter(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def fit(rows: DataFrame, k: int = 10, sample_rows: int = SAMPLE_ROWS, lists: int | None = None) -> Index | None:
    """Centroids by k-means on at most ``sample_rows`` rows, chosen by a hash of the row; None without rows."""
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return None
    dimensions, count = sizes
    # a row's place makes equal rows different, so that a common one fills no more than its share
    hashed = rows.filter(F.size("vector") == dimensions).withColumn("hash", F.xxhash64(F.lit(3), "id", F.monotonically_increasing_id()))
    if count > sample_rows:
        share = min(1.2 * sample_rows / count, 1.0)
        hashed = hashed.filter(F.pmod("hash", F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = hashed.orderBy("hash").limit(sample_rows).collect()
    chosen.sort(key=lambda r: (r.id, r.vector))
    found = np.array([r.vector for r in chosen], np.float64).reshape(-1, dimensions)
    if not len(found):  # by a hash, a few rows may all be passed over
        found = np.zeros((1, dimensions))
    lists = min(lists or max(1, min(int(np.ceil(count**0.5)), len(found) // SAMPLED_A_LIST)), len(found))
    rng = np.random.default_rng(_SEED)
    centres = found[rng.permutation(len(found))[:lists]]
    for _ in range(ROUNDS):
        nearest = np.argmin((centres**2).sum(axis=1) / 2 - found @ centres.T, axis=1)
        centres = np.array([found[nearest == i].mean(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)])
    rotation, _ = np.linalg.qr(rng.normal(size=(dimensions, dimensions)))
    kept = rng.permutation(len(chosen))[: max(1, BOUND_BYTES // (8 * dimensions))]
    index = Index(dimensions, centres, rotation, 1, found[kept], np.array([chosen[i].id for i in kept], np.int64))
    index.probes = _probes(index, found, k, rng)
    return index


def _probes(index: Index, found: np.ndarray, k: int, rng: np.random.Generator) -> int:
    """The number of lists that hold ``RECALL`` of the ``k`` nearest in ``found`` of some of its rows."""
    asked = rng.permutation(len(found))[:MEASURED]
    if len(found) <= 1:
        return 1
    near = (found[asked] ** 2).sum(axis=1)[:, None] + (found**2).sum(axis=1) - 2 * found[asked] @ found.T
    near[np.arange(len(asked)), asked] = np.inf
    k = min(k, len(found) - 1)
    nearest = np.argpartition(near, k - 1, axis=1)[:, :k]
    own = index.near(found)[:, 0]
    order = index.near(found[asked])
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[nearest], axis=1).ravel())
    return int(needed[min(int(np.ceil(RECALL * len(needed))) - 1, len(needed) - 1)]) + 1


def scan(
    block: np.ndarray, rotated: np.ndarray, query: np.ndarray, turned: np.ndarray, k: int, bound: float = np.inf
) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block among the ``k`` nearest found, and more, with their exact distances.

    ``bound`` is a squared distance that the ``k`` nearest of all are not beyond.
    """
    dimensions = block.shape[1]
    kept = np.arange(len(block))
    partial = np.zeros(len(block))
    best = bound
    rounding = 1e-12 * float(turned @ turned)  # of rotated vectors, so that equal distances stay equal
    for begin in range(0, dimensions, COLUMNS):
        end = min(begin + COLUMNS, dimensions)
        difference = rotated[kept, begin:end] - turned[begin:end]
        partial = partial + np.einsum("ij,ij->i", difference, difference)
        if end == dimensions or len(kept) <= k:
            break
        if not begin:  # the nearest so far, measured in full
            first = kept[np.argpartition(partial, k - 1)[:k]]
            best = min(best, float(((block[first] - query) ** 2).sum(axis=1).max()))
        far = partial * (dimensions / end) > best * (1 + EPSILON / np.sqrt(end)) ** 2 + rounding
        kept, partial = kept[~far], partial[~far]
    return kept, np.sqrt(((block[kept] - query) ** 2).sum(axis=1))


_ROW = "list int, block int, query boolean, id long, vector binary, bound double"


def search(rows: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding", index: Index | None = None) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``id`` and ``score``: the ``k`` nearest found of each query.

    ``score`` is the Euclidean distance of the original vectors; ties go to the smaller id.  Candidates are
    all rows but those with the query's id; fewer than ``k`` give fewer rows.  Vectors that are null or
    zero, hold null or non-finite components, have no id, or another length than most take no part.  Rows
    that repeat an id are candidates of their own; a repeated query is asked once, with the least vector.
    Queries that found fewer than ``k`` are asked again of all lists, so that all candidates come if there
    are no more.
    """
    spark = rows.sparkSession
    rows, queries = valid(rows, id, vector), valid(queries, id, vector)
    index = index or fit(rows, k)
    out = f"query_id long, rank int, `{id}` long, score double"
    if index is None:
        return spark.createDataFrame([], out)
    shared = spark.sparkContext.broadcast(index)
    same = F.size("vector") == index.dimensions
    queries = queries.filter(same).groupBy("id").agg(F.min("vector").alias("vector"))
    queries = stage(queries)
    dealt = stage(rows.filter(same).mapInArrow(lambda b: _dealt(b, shared.value, None, k), _ROW))
    counts = {r.list: r["count"] for r in dealt.groupBy("list").count().collect()}  # a row per list
    sizes = np.array([counts.get(i, 0) for i in range(len(index.centroids))], np.int64)
    blocks = -(-sizes // BLOCK_ROWS)
    of_list = F.element_at(F.array(*(F.lit(int(max(b, 1))) for b in blocks)), F.col("list") + 1)
    candidates = dealt.withColumn("block", F.pmod(F.xxhash64("id", "vector"), of_list).cast("int"))

    def found_by(queries: DataFrame, least: int) -> DataFrame:
        asked = queries.mapInArrow(lambda b: _dealt(b, shared.value, sizes, k, least), _ROW)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        met = candidates.union(asked).repartition(parts, "list", "block").sortWithinPartitions("list", "block", "query", "id", "vector")
        found = met.mapInArrow(lambda b: _found(b, shared.value, k), "query_id long, id long, score double")
        order = W.partitionBy("query_id").orderBy("score", "id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found = stage(found_by(queries, max(LEAST_CANDIDATES, k + 1)))
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = queries.join(full, "id", "left_anti")
    if int(sizes.sum()) > max(LEAST_CANDIDATES, k + 1) and not short.isEmpty():
        # most of what was near were rows with the query's own id
        again = found_by(short, int(sizes.sum()))
        found = found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    return found.select("query_id", "rank", F.col("id").alias(id), "score")


def _matrix(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    column = batch.column("vector")
    if pa.types.is_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dimensions)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _dealt(
    batches: Iterator[pa.RecordBatch], index: Index, sizes: np.ndarray | None, k: int, least: int = 0
) -> Iterator[pa.RecordBatch]:
    """Rows by list: a candidate in its own; a query, if ``sizes`` of lists are given, in all blocks of those it probes.

    A query probes ``index.probes`` lists, and further ones until they hold ``least`` vectors.
    """
    for batch in batches:
        for some in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
            matrix = _matrix(some, index.dimensions)
            lists = index.near(matrix)
            bounds = np.zeros(len(matrix))
            if sizes is None:
                row, lists = np.arange(len(matrix)), lists[:, 0]
                block = np.zeros(len(lists), np.int64)
            else:
                bounds = index.bounds(some.column("id").to_numpy(), matrix, k)
                before = np.cumsum(sizes[lists], axis=1) - sizes[lists]
                probed = (np.arange(lists.shape[1]) < index.probes) | (before < least)
                row, place = np.nonzero(probed)
                lists = lists[row, place]
                copies = -(-sizes[lists] // BLOCK_ROWS)
                block = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
                row, lists = np.repeat(row, copies), np.repeat(lists, copies)
            data = pa.array([v.tobytes() for v in matrix], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lists.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(lists), sizes is not None)),
                 some.column("id").take(pa.array(row)), data.take(pa.array(row)), pa.array(bounds[row])],
                [x.split()[0] for x in _ROW.split(", ")],
            )


def _found(batches: Iterator[pa.RecordBatch], index: Index, k: int) -> Iterator[pa.RecordBatch]:
    """The nearest of each block for each of its queries; a block's candidates come before them."""
    now, ids, held, block, rotated = None, [], [], None, None
    for batch in batches:
        out: list[list] = [[], [], []]
        matrix = _matrix(batch, index.dimensions)
        columns = (batch.column(c).to_pylist() for c in ("list", "block", "query", "id", "bound"))
        for place, (of_list, of_block, query, id, bound) in enumerate(zip(*columns, strict=True)):
            if now != (of_list, of_block):
                now, ids, held, block = (of_list, of_block), [], [], None
            if not query:
                ids.append(id)
                held.append(matrix[place])
                continue
            if not ids:
                continue
            if block is None:
                block = np.array(held)
                rotated, names = block @ index.rotation, np.array(ids, np.int64)
            kept, distance = scan(block, rotated, matrix[place], matrix[place] @ index.rotation, k + 1, bound)
            other = (names[kept] != id) & (distance <= np.sqrt(bound) * (1 + 1e-9))
            kept, distance = kept[other], distance[other]
            first = np.lexsort((names[kept], distance))[:k]
            out[0] += [id] * len(first)
            out[1] += names[kept][first].tolist()
            out[2] += distance[first].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "id", "score"])
