"""Samples of a fixed size at most, whatever ids, texts or rows repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RANGE = 1 << 30


def below(place: Column, share: Column) -> Column:
    """Whether a 64-bit hash falls into a share of all."""
    return F.pmod(place, F.lit(_RANGE)).cast("double") < share * F.lit(float(_RANGE))


def at_most(rows: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """Distinct rows, at most ``most`` of each group of the columns ``by``, or of all.

    Rows are chosen by a hash of the whole row, so those that share an id are chosen one by one, and equal
    rows count once.  Expected is a fifth more than ``most`` before the cut; equal rows make it less.
    """
    by = by or []
    place = F.xxhash64(F.lit(11), *rows.columns)
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")) if by else rows.agg(F.count(F.lit(1)).alias("_size"))
    if by:
        # groups are few: languages or labels
        columns = rows.columns
        rows = rows.join(F.broadcast(sizes), by).select(*columns, "_size")
        share = F.lit(1.2 * most) / F.col("_size")
    else:
        share = F.lit(1.2 * most / max(sizes.first()["_size"], 1))
    chosen = rows.filter(below(place, share)).drop("_size").distinct()
    order = [place, *chosen.columns]
    if not by:
        return chosen.orderBy(*order).limit(most)
    order = W.partitionBy(*by).orderBy(*order)
    return chosen.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most).drop("_rank")
