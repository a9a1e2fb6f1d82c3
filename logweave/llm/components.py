"""Connected components of links that no single task or driver could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.operators.joins import join_checked, stage


def connected(links: DataFrame) -> DataFrame:
    """Smallest node that each linked node reaches: ``node``, ``root`` from links ``a``, ``b``.

    Alternates large-star and small-star steps until no link changes: every node is tied to the
    smallest neighbour, so the number of steps grows with the logarithm of the longest path.  Each
    step is kept in shared storage.  The links of a node with very many are spread over several tasks
    (``join_checked``).  Links with a null end or to the node itself are ignored.
    """
    links = stage(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .filter("a < b")
        .distinct()
    )
    before, nodes = None, 2 * links.count()  # at most
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = _star(both, "a < b", nodes)
        links = stage(_star(links.select(F.col("b").alias("a"), F.col("a").alias("b")), "true", nodes).distinct())
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state


def _star(pairs: DataFrame, kept: str, nodes: int) -> DataFrame:
    """Link each node's neighbours, and in a small star the node itself, to the smallest of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    least = least.withColumn("least", F.least("a", "least"))
    joined = join_checked(pairs, least, ["a"], "inner", staged=False, rows=nodes)
    ends = F.array("b") if kept != "true" else F.array("b", "a")
    moved = joined.filter(kept).select(F.explode(ends).alias("b"), F.col("least").alias("a"))
    return moved.filter("a < b").select("a", "b").distinct()
