"""Log files as lines."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from logweave.functions.globs import matches_any
from logweave.functions.timespec import Period, expand_paths, last_period
from logweave.operators.joins import join_checked, stage
from logweave.sources.selection import Selection, plain_name

# Blocks whose line counts are broadcast, at some 150 bytes each.
BROADCAST_BLOCKS = 2_000_000


def file_name(path: Column) -> Column:
    """A file URI as a plain path: local ones lose the scheme, %-escapes are undone."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, r"\Afile:/+", "/")


def base_name(file: Column) -> Column:
    return F.substring_index(file, "/", -1)


def dir_name(file: Column) -> Column:
    return F.regexp_extract(file, r"\A(.*)/[^/]*\z", 1)


def file_included(
    file: Column,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    exclude_dir: Iterable[str] = (),
) -> Column:
    """Directory exclusion first, then name exclusion, then inclusion."""
    keep = F.lit(True)
    if exclude_dir := list(exclude_dir):
        keep = keep & ~matches_any(dir_name(file), exclude_dir)
    if exclude := list(exclude):
        keep = keep & ~matches_any(base_name(file), exclude)
    if include := list(include):
        keep = keep & matches_any(base_name(file), include)
    return keep


def read_globs(spark: SparkSession, path: str) -> list[str]:
    """Globs listed in a file, one per line, for ``exclude``."""
    return [r.value for r in spark.read.text(path).filter("value != ''").toLocalIterator()]


def find_files(spark: SparkSession, paths: str | Iterable[str], recursive: bool = False) -> tuple[list[str], list[str]]:
    """Paths and globs that mean some file, and those that mean none (S9); every path is judged by itself."""
    selection = Selection(spark, paths, recursive)
    return selection.found, selection.missing


def scan_files(
    spark: SparkSession,
    paths: str | Iterable[str] | Selection,
    recursive: bool = False,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    exclude_dir: Iterable[str] = (),
    modified_after: dt.datetime | None = None,
) -> DataFrame:
    """Bytes of every line with its file, without line numbers.

    Of several paths each file is read once, however many of them mean it; paths that
    mean none are passed over, unless all do.  Conditions on the name and on the
    modification time are conditions on file metadata, so Spark drops the files when
    it plans the scan.
    """
    if not isinstance(paths, Selection):
        paths = [paths] if isinstance(paths, str) else list(dict.fromkeys(paths))
        if len(paths) > 1:  # alone, a path means no file twice
            paths = Selection(spark, paths, recursive)
    if isinstance(paths, Selection):
        paths, recursive = paths.to_read() or paths.paths, True
    _pin_splits(spark)
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.text(paths)
    path = F.col("_metadata.file_path")
    mtime = F.col("_metadata.file_modification_time")
    if include or exclude or exclude_dir:
        df = df.filter(file_included(file_name(path), include, exclude, exclude_dir))
    if modified_after is not None:
        df = df.filter(mtime >= F.lit(modified_after.isoformat(" ")).cast("timestamp"))
    return df.select(
        path.alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        mtime.alias("file_mtime"),
        F.col("value"),
    )


def modified_since(lines: DataFrame, start: dt.datetime) -> DataFrame:
    """Lines of files that were written to after ``start``: older ones hold nothing newer."""
    return lines.filter(F.col("file_mtime") >= F.lit(start.isoformat(" ")).cast("timestamp"))


def missing_inputs(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Requested paths (column ``path``) that no file was found for (column ``file``)."""
    return join_checked(
        requested, found.select(F.col("file").alias("path")).distinct(), ["path"], "left_anti"
    )


def decode_lines(df: DataFrame, file: str = "file", value: str = "value") -> DataFrame:
    """Bytes of lines as text ``raw``: UTF-8, or Latin-1 for all lines of a file with other bytes."""
    data = F.col(value).cast("binary")
    text = F.col(value).cast("string")
    bad = df.filter(~F.is_valid_utf8(text)).select(file).distinct().withColumn("_latin1", F.lit(True))
    joined = join_checked(df, bad, [file], "left")
    latin1 = F.decode(data, "ISO-8859-1")
    return joined.withColumn("raw", F.when(F.col("_latin1"), latin1).otherwise(text)).drop("_latin1")


def _pin_splits(spark: SparkSession) -> None:
    """Keep the split plan of a scan the same when executors come and go.

    The number of cores seen at planning time would otherwise decide it, and two
    passes over the files must agree on the splits.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def read_lines(
    spark: SparkSession,
    paths: str | Iterable[str] | Selection,
    recursive: bool = False,
    include: Iterable[str] = (),
    exclude: Iterable[str] = (),
    exclude_dir: Iterable[str] = (),
    modified_after: dt.datetime | None = None,
    block_rows: int = BROADCAST_BLOCKS,
) -> DataFrame:
    """Lines with exact numbers: ``file, file_mtime, line_no, raw``.

    A first pass counts the lines of every file block; a line's number is its
    place in the block plus the lines of the blocks before it.  Lines are neither
    sorted nor shuffled.  The same pass tells which files are not valid UTF-8;
    those are read as Latin-1 throughout.
    """
    scan = scan_files(spark, paths, recursive, include, exclude, exclude_dir, modified_after)
    blocks = stage(
        scan.groupBy("_path", "_block").agg(
            F.min("_row").alias("_first"),
            F.count(F.lit(1)).alias("_n"),
            F.bool_and(F.is_valid_utf8("value")).alias("_utf8"),
        )
    )
    file = W.partitionBy("_path")
    earlier = file.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "_path",
        "_block",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
        F.min("_utf8").over(file).alias("_utf8"),
        F.col("_first"),
        F.col("_n"),
        file_name(F.col("_path")).alias("file"),
    )
    if blocks.count() <= block_rows:
        blocks = F.broadcast(blocks)
    joined = scan.join(blocks, ["_path", "_block"], "left")
    place = F.col("_row") - F.col("_first")
    line_no = F.when(place.between(0, F.col("_n") - 1), F.col("_row") + F.col("_shift")).otherwise(
        F.raise_error(F.lit("files changed while they were read")).cast("bigint")
    )
    latin1 = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    return joined.select(
        "file",
        "file_mtime",
        line_no.alias("line_no"),
        F.when(F.col("_utf8"), F.col("value")).otherwise(latin1).alias("raw"),
    )


def read_apps(
    spark: SparkSession,
    apps: Iterable,
    logdir: str,
    period: Period | None = None,
    hosts: Iterable[str] = (),
    **options,
) -> tuple[DataFrame, list[str]]:
    """Lines of the files that the given apps name, and the paths that were missing.

    Without a period it is the last day that is read.  Every file is read once, in one
    scan, however many apps name it: ``source_apps`` has them in order of priority,
    ``source_app`` is the first.  Date and host templates are filled from the period
    and hosts.
    """
    period = last_period("day") if period is None else period
    if period[0] is not None:
        options.setdefault("modified_after", period[0])
    named: dict[str, list[tuple[int, str]]] = {}  # path -> apps
    for place, app in enumerate(sorted(apps, key=lambda a: (a.priority, a.name))):
        templates = [f.replace("${logdir}", logdir.rstrip("/")) for f in app.files]
        for row in expand_paths(spark, templates, period, list(hosts)).orderBy("path").toLocalIterator():
            named.setdefault(row.path, []).append((place, app.name))
    selection = Selection(spark, named, options.pop("recursive", False))
    if not selection.globs or len(selection.missing) == len(named):
        raise ValueError("no file of the selected apps exists in the period")
    rows = [(k, place, name) for k, path in enumerate(selection.paths) for place, name in named[path]]
    asked = F.broadcast(spark.createDataFrame(rows, "given int, place int, app string"))
    of_file = selection.matches.join(asked, "given").groupBy(plain_name(F.col("path")).alias("file"))
    table = of_file.agg(F.array_sort(F.collect_set(F.struct("place", "app")))["app"].alias("source_apps"))
    lines = join_checked(read_lines(spark, selection, **options), table, ["file"], "left")
    return lines.withColumn("source_app", F.get("source_apps", F.lit(0))), selection.missing
