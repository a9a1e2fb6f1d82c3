"""Merkle fixity audit of archive replicas.

Records of an archive file lie at offsets.  A leaf is a range of offsets: the hash of the digests of the
records that begin there, in order.  A node of the next level is the hash of up to ``FANOUT`` ranges next to
each other, and so on up to one root per file.  Two replicas are compared from the roots down: only children
of nodes that differ are read, so the damage is found from a few nodes and the records of the ranges it is in.

All of it is grouping and joining by (file, range), with SQL functions only.  A file may be as large as it
likes: a group never has more than a range's records or ``FANOUT`` nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.joins import stage

#: Bytes of a leaf's range, and ranges below a node.
RANGE_BYTES, FANOUT = 1 << 16, 16


def records_of(rows: DataFrame, file: str, order: str, payload: list[str]) -> DataFrame:
    """``file``, ``offset``, ``length`` and ``digest`` of records laid out in ``order``.

    Null parts of a payload are empty and told apart from empty ones.  Rows with null ``order`` come first;
    equal ones in order of their digests.  Offsets are sums over a file, so a file must be of bounded size
    here, as archives are; offsets that are known need no such sum.
    """
    from pyspark.sql import Window as W

    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in payload]
    body = F.concat_ws("\x1e", *parts)
    found = rows.select(
        F.col(file).alias("file"), F.col(order).alias("place"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("length")
    )
    window = W.partitionBy("file").orderBy("place", "digest", "length").rowsBetween(W.unboundedPreceding, -1)
    return found.select("file", "place", F.coalesce(F.sum("length").over(window), F.lit(0)).alias("offset"), "length", "digest")


def trees(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves up: ``file``, ``node`` and ``hash``; the last has one node per file.

    Records need ``file``, ``offset``, ``length`` and ``digest``.  Rows with null offset lie at offset 0 and
    are told apart; equal rows count as often as they come.  No records give no nodes.
    """
    same = ["file", "offset", "length", "digest"]
    counted = records.groupBy(*same).count()
    line = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("offset", "length", "digest", "count")))
    place = F.struct(F.col("offset"), F.col("length"), F.col("digest"), line.alias("line"))
    node = F.floor(F.coalesce("offset", F.lit(0)) / range_bytes).cast("long").alias("node")
    leaves = counted.select("file", node, place.alias("place")).groupBy("file", "node")
    leaves = leaves.agg(_joined(F.array_sort(F.collect_list("place")), "line").alias("hash"))
    levels = [stage(leaves)]
    while True:
        top = levels[-1].agg(F.max("node")).first()[0]
        if not top:
            return levels
        up = levels[-1].select("file", F.floor(F.col("node") / fanout).cast("long").alias("up"), F.struct("node", F.concat_ws(":", F.col("node").cast("string"), "hash").alias("line")).alias("child"))
        up = up.groupBy("file", F.col("up").alias("node")).agg(_joined(F.array_sort(F.collect_list("child")), "line").alias("hash"))
        levels.append(stage(up))


def _joined(children, field: str):
    return F.sha2(F.array_join(F.transform(children, lambda c: c[field]), "\n"), 256)


def audit(one: DataFrame, two: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records that the replicas do not share: ``file``, ``offset``, ``kind`` and both lengths and digests.

    ``kind`` is ``changed`` if each has one record at the offset, ``missing`` if only ``one`` has records
    there, ``extra`` if only ``two`` has, and ``repeated`` if one of them has several.  Equal replicas, and
    empty ones, give no rows.  A null file is a file of its own.
    """
    up_one, up_two = trees(one, range_bytes, fanout), trees(two, range_bytes, fanout)
    wanted = None
    for level in range(max(len(up_one), len(up_two)) - 1, -1, -1):
        # above its own root a tree has the root again
        sides = [t[min(level, len(t) - 1)] for t in (up_one, up_two)]
        if wanted is not None:
            sides = [_within(t, wanted, F.floor(F.col("node") / fanout)) for t in sides]
        both = _side_by_side(*sides, "node").filter("NOT a.hash <=> b.hash")
        wanted = stage(both.select("file", "node"))
    sides = []
    for records in (one, two):
        own = _within(records.select("file", "offset", "length", "digest"), wanted, F.floor(F.coalesce("offset", F.lit(0)) / range_bytes))
        sides.append(
            own.groupBy("file", "offset").agg(
                F.count("*").alias("n"),
                F.min(F.struct("length", "digest")).alias("least"),
                F.sum(F.xxhash64("length", "digest").cast("decimal(38,0)")).alias("all"),
            )
        )
    both = _side_by_side(*sides, "offset").filter("NOT (a.n <=> b.n AND a.least <=> b.least AND a.all <=> b.all)")
    return both.selectExpr(
        "file",
        "offset",
        "CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' WHEN a.n + b.n > 2 THEN 'repeated' ELSE 'changed' END AS kind",
        "a.least.length AS one_length",
        "a.least.digest AS one_digest",
        "b.least.length AS two_length",
        "b.least.digest AS two_digest",
    )


def _side_by_side(one: DataFrame, two: DataFrame, place: str) -> DataFrame:
    """``file`` and ``place`` of either, with the rows of both as ``a`` and ``b``, null where there is none."""
    names = ["file", place]
    a, b = (t.select(*names, F.struct(*(c for c in t.columns if c not in names)).alias(n)) for t, n in ((one, "a"), (two, "b")))
    return a.withColumn("b", F.lit(None).cast(b.schema["b"].dataType)).unionByName(
        b.withColumn("a", F.lit(None).cast(a.schema["a"].dataType))
    ).groupBy(*names).agg(F.max("a").alias("a"), F.max("b").alias("b"))


def _within(rows: DataFrame, wanted: DataFrame, node) -> DataFrame:
    """Rows below nodes that differ."""
    wanted = wanted.select(F.col("file").alias("_file"), F.col("node").alias("_node"))
    return rows.join(wanted, F.col("file").eqNullSafe(F.col("_file")) & (node.cast("long") == F.col("_node")), "left_semi")
