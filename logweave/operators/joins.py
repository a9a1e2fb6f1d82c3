"""Joins against a side that is usually small, and shared storage for cut plans."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

# A side with more rows than this is never broadcast.
BROADCAST_ROWS = 500_000
# Bits that tell which keys a semi-join may have; their numbers take 32 bytes each where they are broadcast.
BITMAP_BITS = 1 << 22
# Rows of one key that go to one task in a shuffled join.
HOT_ROWS = 4_000_000


def join_checked(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    staged: bool = True,
    rows: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Join a large left side to a right side that tends to be small.

    The right side is counted, unless the caller knows its ``rows``: up to
    ``broadcast_rows`` it is broadcast, and the left side is not shuffled.  Beyond
    that both are, and left rows of a key that has more than ``hot_rows`` of them
    are spread over several tasks.  ``staged`` keeps the right side in shared
    storage first; leave it out for a table that is cheap to read again.  ``how``
    is one of ``inner``, ``left``, ``left_semi``, ``left_anti``; under the first
    two the right side must hold each key once.  With ``hot_rows=None`` the caller
    vouches that no key has many rows.
    """
    if staged:
        right = stage(right)
    if rows is None:
        rows = right.count() if staged else right.limit(broadcast_rows + 1).count()
    if rows <= broadcast_rows:
        return left.join(F.broadcast(right), on, how)
    if hot_rows is None:
        return left.join(right, on, how)
    return _join_salted(left, right, on, how, hot_rows)


def _join_salted(left: DataFrame, right: DataFrame, on: list[str], how: str, hot_rows: int) -> DataFrame:
    """Shuffled join in which a hot key takes as many tasks as it has rows for.

    The left keys are counted first.  A hot key gets one salt per ``hot_rows``
    rows, and only its row of the right side is copied.  The table of hot keys has
    at most (left rows / ``hot_rows``) rows, so it is broadcast.
    """
    counts = left.select(*on).groupBy(*on).count().dropna()
    return join_counted(left, right, on, how, counts, row_hash(left, on), hot_rows)


def join_counted(
    left: DataFrame, right: DataFrame, on: list[str], how: str, counts: DataFrame, spread_by: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The same for keys whose rows on the left are known: ``counts`` has them as ``count``.

    Rows of a hot key go by ``spread_by``, a hash of what tells them apart.
    """
    salts = F.ceil(F.col("count") / hot_rows).cast("int")
    hot = F.broadcast(stage(counts.filter(F.col("count") > hot_rows).select(*on, salts.alias("_salts"))))
    no_key = F.lit(False)
    for key in on:
        no_key = no_key | F.col(key).isNull()
    # rows without key never match; they are spread to keep them out of one task
    buckets = F.coalesce(F.col("_salts"), F.when(no_key, 1024), F.lit(1))
    left = left.join(hot, on, "left").withColumn("_salt", F.pmod(spread_by, buckets).cast("int"))
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = right.join(hot, on, "left").withColumn("_salt", F.explode(copies))
    return left.drop("_salts").join(right.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def semi_join(left: DataFrame, right: DataFrame, on: list[str], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows of ``left`` whose key is in ``right``, which tends to have few of the keys.

    Beyond ``broadcast_rows`` keys, the keys are first thinned out by a bitmap of
    ``BITMAP_BITS`` bits: the numbers of the bits that are set are broadcast, and
    only rows whose key has its bit set are shuffled to the keys themselves.
    """
    right = stage(right.select(*on))
    rows = right.count()
    columns = left.columns
    if rows <= broadcast_rows:
        return left.join(F.broadcast(right), on, "left_semi").select(*columns)
    bit = F.pmod(F.xxhash64(*on), F.lit(BITMAP_BITS)).cast("int").alias("_bit")
    set_ = stage(right.select(bit).distinct())
    left = left.withColumn("_bit", bit).join(F.broadcast(set_), ["_bit"], "left_semi").drop("_bit")
    kept = join_checked(left, right, on, "left_semi", staged=False, rows=rows, broadcast_rows=broadcast_rows)
    return kept.select(*columns)


def row_hash(df: DataFrame, keys: list[str]) -> Column:
    """Hash of the other columns of a row: the same in every retry of a task."""
    plain = [
        f.name
        for f in df.schema.fields
        if f.name not in keys and isinstance(f.dataType, AtomicType)
    ]
    return F.xxhash64(*plain) if plain else F.lit(0).cast("bigint")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for data between steps.

    It is the one the cluster names in ``spark.checkpoint.dir``.  Only a local
    session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="logweave-")
    context.setCheckpointDir(own)
    return context.getCheckpointDir()


def _stage_dir(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/logweave-{spark.sparkContext.applicationId}"


def drop_stages(spark: SparkSession) -> None:
    """Delete the tables this application has staged, once their results are written."""
    delete_path(spark, _stage_dir(spark))


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it as a table in the shared folder.

    Later steps read only the columns they need, and a lost executor costs no more
    than reading a part again.
    """
    return _staged_at(df, f"{_stage_dir(df.sparkSession)}/{uuid.uuid4().hex}")


def _staged_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame):
    """The staged table, for a block of code; it is deleted at the end of the block."""
    path = f"{_stage_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    try:
        yield _staged_at(df, path)
    finally:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, if there is one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def spread(df: DataFrame) -> DataFrame:
    """Spread an input of fewer splits than cores over all cores.

    A small file is one split, and the regular expressions that follow would run
    on one core.  So they would where a file of many splits has its rows in few row
    groups: the other splits are empty.  Where a table can be counted without reading
    it, as Parquet can, that is found out.  An input with enough filled splits is left as it is.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores and all(f.endswith(".parquet") for f in df.inputFiles()):
        filled = df.select(F.spark_partition_id().alias("split")).distinct().count()
    else:
        filled = splits
    return df.repartition(max(cores, splits)) if filled < cores else df
