"""Work that depends on the order of lines, without putting a file in one task.

A file may hold a third of all lines.  So nothing here sorts or windows over a
whole file: lines are cut into chunks of consecutive line numbers, every chunk is
handled on its own, and what a chunk must know of the others travels in a table
with one small row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.joins import join_checked, stage

# Consecutive line numbers handled together by one task.
CHUNK_LINES = 65_536
# For context the chunks are smaller, as all lines of a chunk near a match are kept.
CONTEXT_LINES = 8_192
# Sorted rows per task when lines are numbered.
ROWS_PER_RANGE = 1_000_000
# Tasks that a numbering is spread over at most; more would burden the shuffle.
MAX_RANGES = 20_000


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str = "line_no",
    staged: bool = True,
    bound: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Exact row numbers from 1 per key in the given order.

    Up to ``rows_per_range`` rows in all, a window does it.  More are range
    partitioned and sorted by (keys, order), which splits a hot key over many
    tasks, and kept in shared storage so that later passes see the same
    partitions.  The number is then the position in the partition plus the rows of
    earlier partitions, minus the position where the key begins.  ``staged`` keeps
    the input too; leave it out for one that is cheap to read again.  A caller who
    knows that there are at most ``bound`` rows saves the count of a small input.
    """
    small = bound is not None and bound <= rows_per_range
    if staged and not small:
        df = stage(df)
    rows = bound if small else df.count()
    if rows <= rows_per_range:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(session, min(-(-rows // rows_per_range), MAX_RANGES))
    placed = stage(
        df.repartitionByRange(ranges, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    # one row per partition: a table bounded by the number of partitions
    before = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(W.orderBy("_part")) - F.col("_n"))
        .drop("_n")
    )
    placed = placed.join(F.broadcast(before), "_part").withColumn(
        "_at", F.col("_before") + F.col("_row")
    )
    begin = placed.groupBy(*keys).agg(F.min("_at").alias("_begin"))
    return (
        join_checked(placed, begin, keys, "inner")
        .withColumn(name, F.col("_at") - F.col("_begin") + 1)
        .drop("_part", "_row", "_before", "_at", "_begin")
    )


def chunk_of(order: str = "line_no", lines: int = CHUNK_LINES) -> Column:
    return F.expr(f"`{order}` DIV {lines}")


@dataclass(frozen=True)
class Running:
    """A running aggregate: ``agg`` over this row and the earlier (or later) ones.

    ``agg`` is ``sum``, ``max`` or ``min``.  ``backward`` runs from the end;
    ``inclusive=False`` leaves the row itself out.
    """

    name: str
    agg: str
    value: Column
    backward: bool = False
    inclusive: bool = True


_AGG: dict[str, Callable] = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: list[str],
    scans: list[Running],
    order: str = "line_no",
    lines: int = CHUNK_LINES,
    needed: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add running aggregates per key, exact across chunks.

    The chunk table holds the aggregate of each chunk and, by a window over that
    table alone, of all chunks before (after) it.  ``needed`` may filter the chunk
    table, whose columns are the carried values under the scan names; rows of the
    chunks it drops are not shuffled.
    """
    chunk = [*keys, "_chunk"]
    df = df.withColumn("_chunk", chunk_of(order, lines))
    table = df.groupBy(*chunk).agg(
        *[_AGG[s.agg](s.value).alias(s.name) for s in scans], F.count(F.lit(1)).alias("_rows")
    )
    for s in scans:
        by = F.col("_chunk").desc() if s.backward else F.col("_chunk").asc()
        earlier = W.partitionBy(*keys).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        table = table.withColumn(f"_c_{s.name}", _AGG[s.agg](s.name).over(earlier))
    carried = [f"_c_{s.name}" for s in scans]
    if needed is None:
        # the windows below need the same partitions as this join
        out = df.join(table.select(*chunk, *carried), chunk)
    else:
        some = needed(table).select(*chunk, *carried)
        out = join_checked(df, some, chunk, "inner", hot_rows=None)
    for s in scans:
        by = F.col(order).desc() if s.backward else F.col(order).asc()
        here = W.partitionBy(*chunk).orderBy(by)
        here = here.rowsBetween(W.unboundedPreceding, 0 if s.inclusive else -1)
        local, carry = _AGG[s.agg](s.value).over(here), F.col(f"_c_{s.name}")
        if s.agg == "sum":
            value = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif s.agg == "max":
            value = F.greatest(local, carry)
        else:
            value = F.least(local, carry)
        out = out.withColumn(s.name, value)
    return out.drop("_chunk", *carried)


def first_rows(df: DataFrame, keys: list[str], n: int, order: str = "line_no") -> DataFrame:
    """The first ``n`` rows per key.

    A small ``n`` is cut per task before the shuffle, by chunk and then by key.  A
    large one is counted chunk by chunk, and only chunks that begin within the
    first ``n`` rows are shuffled.
    """
    if n <= 1000:
        chunk = W.partitionBy(*keys, "_chunk").orderBy(order)
        cut = (
            df.withColumn("_chunk", chunk_of(order))
            .withColumn("_rn", F.row_number().over(chunk))
            .filter(F.col("_rn") <= n)
        )
        whole = W.partitionBy(*keys).orderBy(order)
        cut = cut.withColumn("_rn", F.row_number().over(whole)).filter(F.col("_rn") <= n)
        return cut.drop("_chunk", "_rn")
    begins = lambda t: t.filter(F.coalesce("_c__rn", F.lit(0)) < n)
    ranked = running(df, keys, [Running("_rn", "sum", F.lit(1))], order, needed=begins)
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def with_distance(
    df: DataFrame,
    keys: list[str],
    selected: str,
    before: int,
    after: int,
    order: str = "line_no",
    lines: int = CONTEXT_LINES,
) -> DataFrame:
    """Rows that are selected or near a selected row of the same key.

    Distance counts the rows of ``df``: the ``before`` rows ahead of a selected
    one and the ``after`` rows behind it stay.  A first pass finds the chunks that
    hold a selected row or may touch one; only their rows are kept, in shared
    storage, and shuffled to take the exact distances.
    """
    chunk = [*keys, "_chunk"]
    df = df.withColumn("_chunk", chunk_of(order, lines))
    hit = F.col(selected)
    chunks = _near_chunks(df, keys, chunk, hit, before, after)
    # a chunk has at most `lines` rows, so none is hot
    near = stage(join_checked(df, chunks, chunk, "inner", hot_rows=None))
    return _by_distance(near, keys, chunk, hit, before, after, order)


def _near_chunks(df, keys, chunk, hit, before, after) -> DataFrame:
    """Chunks with a selected row, or fewer rows than the context away from such a chunk."""
    table = df.groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_or(F.coalesce(hit, F.lit(False))).alias("_hit")
    )
    up = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(W.unboundedPreceding, -1)
    table = table.withColumn("_start", F.coalesce(F.sum("_n").over(up), F.lit(0)))
    end = F.col("_start") + F.col("_n")
    return (
        table.withColumn("_end_hit", F.max(F.when(F.col("_hit"), end)).over(up))
        .withColumn("_start_hit", F.min(F.when(F.col("_hit"), F.col("_start"))).over(down))
        .filter(
            F.col("_hit")
            | (F.col("_start") - F.col("_end_hit") < after)
            | (F.col("_start_hit") - end < before)
        )
        .select(*chunk, "_start")
    )


def _by_distance(near, keys, chunk, hit, before, after, order) -> DataFrame:
    """Exact distances: in the chunk itself, and by its table to the chunks around it."""
    in_chunk = W.partitionBy(*chunk).orderBy(order)
    near = near.withColumn("_at", F.col("_start") + F.row_number().over(in_chunk))
    mark = F.when(hit, F.col("_at"))
    up = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(W.unboundedPreceding, -1)
    table = near.groupBy(*chunk).agg(F.max(mark).alias("_last"), F.min(mark).alias("_first"))
    table = table.select(
        *chunk, F.max("_last").over(up).alias("_prev"), F.min("_first").over(down).alias("_next")
    )
    near = near.join(table, chunk)
    here = in_chunk.rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(*chunk).orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, 0)
    near = near.withColumn("_prev", F.greatest(F.max(mark).over(here), F.col("_prev"))).withColumn(
        "_next", F.least(F.min(mark).over(back), F.col("_next"))
    )
    kept = (F.col("_at") - F.col("_prev") <= after) | (F.col("_next") - F.col("_at") <= before)
    return near.filter(hit | F.coalesce(kept, F.lit(False))).drop(
        "_chunk", "_start", "_prev", "_next", "_at"
    )
