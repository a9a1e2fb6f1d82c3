"""Sources and file selection."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from catalog import apps, views
from catalog.registry import query
from logweave import streaming
from logweave.functions.timespec import date_path, date_period, host_path
from logweave.operators.joins import checkpoint_dir
from logweave.operators.search import Patterns
from logweave.sources import sinks
from logweave.sources.files import (
    decode_lines,
    file_included,
    missing_inputs,
    modified_since,
    read_apps,
    read_lines,
)
from logweave.sources.sinks import to_directory
from logweave.streaming import read_line_stream


def _written(spark, sf_dir: str) -> str:
    """Lines of the events table as text files in the shared folder."""
    path = f"{checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    views.lines(spark, sf_dir).select("file", F.col("raw").alias("value")).write.partitionBy(
        "file"
    ).text(path)
    return path


@query(
    f"""WITH {views.EVENTS}
    SELECT file AS day, count(*) AS lines, count(*) AS numbers, CAST(0 AS BIGINT) AS gaps
    FROM e GROUP BY file"""
)
def read_files_with_line_numbers(spark, sf_dir):
    """Write lines to files, read them back; numbers of a file run from 1 without gaps."""
    back = read_lines(spark, _written(spark, sf_dir), recursive=True)
    per_file = back.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_distinct("line_no").alias("numbers"),
        (F.max("line_no") - F.count(F.lit(1))).alias("gaps"),
    )
    day = F.regexp_extract("file", "file=([^/]+)/", 1).alias("day")
    return per_file.groupBy(day).agg(
        F.sum("lines").alias("lines"), F.sum("numbers").alias("numbers"), F.sum("gaps").alias("gaps")
    )


def _one_file_a_day(spark, sf_dir: str) -> str:
    """The lines in order of their events, as one text file a day."""
    path = f"{checkpoint_dir(spark)}/days-{uuid.uuid4().hex}"
    lines = views.lines(spark, sf_dir).select("file", "event_id", F.col("raw").alias("value"))
    ordered = lines.repartition("file").sortWithinPartitions("file", "event_id")
    ordered.select("file", "value").write.partitionBy("file").text(path)
    return path


@query(
    f"""WITH {views.NUMBERED}
    SELECT file AS day, row_number() OVER (PARTITION BY file ORDER BY event_id) AS line_no, raw FROM l"""
)
def number_lines_of_files(spark, sf_dir):
    """Which line has which number, in files written in a known order."""
    back = read_lines(spark, _one_file_a_day(spark, sf_dir), recursive=True)
    return back.select(F.regexp_extract("file", "file=([^/]+)/", 1).alias("day"), "line_no", "raw")


@query(
    f"""WITH {views.EVENTS} SELECT file AS day, count(*) AS lines FROM e
    WHERE CAST(strptime(substr(file, 5), '%Y%m%d') AS DATE) >= DATE '2024-01-20' GROUP BY file"""
)
def prune_files_by_their_times(spark, sf_dir):
    """Files whose modification time is set to their day; those of earlier days are not read."""
    root = _one_file_a_day(spark, sf_dir)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/file=*/*.txt")):  # a file a day
        day = status.getPath().getParent().getName()[-8:]
        noon = dt.datetime.strptime(day, "%Y%m%d").replace(hour=12, tzinfo=dt.timezone.utc)
        fs.setTimes(status.getPath(), int(noon.timestamp() * 1000), -1)
    kept = read_lines(spark, root, recursive=True, modified_after=dt.datetime(2024, 1, 20))
    day = F.regexp_extract("file", "file=([^/]+)/", 1).alias("day")
    return kept.groupBy(day).agg(F.count(F.lit(1)).alias("lines"))


@query(
    r"""SELECT CAST(doc_id AS VARCHAR) AS file, text AS raw,
        doc_id % 2 = 0 AND regexp_matches(text, '[\x{80}-\x{FF}]') AND NOT regexp_matches(text, '[^\x{00}-\x{FF}]') AS other
    FROM documents"""
)
def decode_other_bytes(spark, sf_dir):
    """Every other text in Latin-1, where it can be, which is no valid UTF-8 if it has accents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), "doc_id", "text")
    fits = (F.col("doc_id") % 2 == 0) & ~F.col("text").rlike(r"[^\x{00}-\x{FF}]")
    data = F.when(fits, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    decoded = decode_lines(docs.select("file", data.alias("value")))
    return decoded.select("file", "raw", (~F.is_valid_utf8(F.col("value").cast("string"))).alias("other"))


@query(
    f"""WITH {views.EVENTS}
    SELECT file AS day, count(*) AS lines FROM e WHERE file LIKE 'day-2024010%' GROUP BY file"""
)
def read_files_by_glob(spark, sf_dir):
    """Two overlapping globs: a file that both match is read once."""
    root = _written(spark, sf_dir)
    found = read_lines(
        spark, [f"{root}/file=day-2024010*/*", f"{root}/file=day-20240105/*"], include=["*.txt"]
    )
    day = F.regexp_extract("file", "file=([^/]+)/", 1).alias("day")
    return found.groupBy(day).agg(F.count(F.lit(1)).alias("lines"))


@query(
    f"""WITH {views.EVENTS} SELECT 'shop' AS source_app, file AS day, count(*) AS lines FROM e
    WHERE file BETWEEN 'day-20240108' AND 'day-20240112' GROUP BY file
    UNION ALL SELECT 'web', file, count(*) FROM e WHERE file = 'day-20240120' GROUP BY file"""
)
def read_app_files(spark, sf_dir):
    """Files come from the rule packs, with the days of a period filled in.

    A file that two packs name belongs to the first by priority.
    """
    root = _written(spark, sf_dir)
    packs = [
        replace(apps.SHOP, files=("${logdir}/file=day-%Y%m%d/*.txt",)),
        replace(apps.WEB, files=("${logdir}/file=day-20240110/*.txt", "${logdir}/file=day-20240120/*.txt")),
    ]
    found, _ = read_apps(spark, packs, root, date_period("20240108,20240112"))
    day = F.regexp_extract("file", "file=([^/]+)/", 1).alias("day")
    return found.groupBy("source_app", day).agg(F.count(F.lit(1)).alias("lines"))


@query(
    """SELECT page_id, url FROM pages
    WHERE NOT regexp_matches(regexp_extract(url, '^(.*)/[^/]*$', 1, 's'), '^https://[^\\n]*\\.org/[^\\n]*$')
      AND regexp_extract(url, '[^/]*$') NOT LIKE '%#top'
      AND regexp_matches(regexp_extract(url, '[^/]*$'), '^[1-6].*$')"""
)
def filter_paths_by_globs(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return pages.filter(
        file_included(
            F.col("url"), include=["[1-6]*"], exclude=["*#top"], exclude_dir=["https://*.org/*"]
        )
    )


@query(
    f"""WITH {views.EVENTS}
    SELECT DISTINCT '/var/log/' || strftime(ts, '%Y/%m/app-%Y%m%d') || '.' || strftime(ts, '%j-%a-%A-%b-%B-%w-%y')
           || '.log' AS path FROM e"""
)
def expand_date_paths(spark, sf_dir):
    days = views.events(spark, sf_dir).select(F.to_date("ts").alias("day")).distinct()
    return days.select(
        date_path("/var/log/%Y/%m/app-%Y%m%d.%j-%a-%A-%b-%B-%w-%y.log", F.col("day")).alias("path")
    )


@query(
    f"""WITH {views.EVENTS}
    SELECT '/var/log/host' || h || strftime(ts, '/%Y/%m/%d.log') AS path, count(*) AS events FROM e GROUP BY 1"""
)
def expand_host_paths(spark, sf_dir):
    events = views.events(spark, sf_dir).withColumn("host", F.concat(F.lit("host"), "h"))
    template = date_path("/var/log/${host}/%Y/%m/%d.log", F.col("ts"))
    path = host_path(template, F.col("host")).alias("path")
    return events.groupBy(path).agg(F.count(F.lit(1)).alias("events"))


@query(
    f"""WITH {views.EVENTS}
    SELECT file, count(*) AS lines FROM e
    WHERE CAST(strptime(substr(file, 5), '%Y%m%d') AS DATE) + INTERVAL 1 DAY >= TIMESTAMP '2024-01-20 00:00:00'
    GROUP BY file"""
)
def prune_files_by_modification_time(spark, sf_dir):
    closed = F.to_timestamp(F.substring("file", 5, 8), "yyyyMMdd") + F.expr("interval 1 day")
    lines = views.lines(spark, sf_dir).withColumn("file_mtime", closed)
    kept = modified_since(lines, dt.datetime(2024, 1, 20))
    return kept.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file, length(text) AS chars, text AS raw FROM documents")
def decode_bytes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    data = docs.select(F.col("doc_id").cast("string").alias("file"), F.encode("text", "UTF-8").alias("value"))
    return decode_lines(data).select("file", F.length("raw").cast("bigint").alias("chars"), "raw")


@query(
    f"""WITH {views.EVENTS}
    SELECT 'day-' || strftime(d, '%Y%m%d') AS path
    FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)) + INTERVAL 5 DAY, INTERVAL 1 DAY)) AS d FROM e)
    WHERE 'day-' || strftime(d, '%Y%m%d') NOT IN (SELECT file FROM e)"""
)
def report_missing_inputs(spark, sf_dir):
    events = views.events(spark, sf_dir)
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    days = span.select(
        F.explode(F.expr("sequence(to_date(a), to_date(b) + 5, interval 1 day)")).alias("day")
    )
    requested = days.select(date_path("day-%Y%m%d", F.col("day")).alias("path"))
    return missing_inputs(requested, events.select("file"))


@query(f"WITH {views.NUMBERED} SELECT file, line_no, event_id, raw FROM l")
def number_table_lines(spark, sf_dir):
    """Rows of a table as numbered lines, in time order."""
    return views.numbered(spark, sf_dir).select("file", "line_no", "event_id", "raw")


@query(f"WITH {views.CORPUS} SELECT file, CAST(line_no AS BIGINT) AS line_no, raw FROM c")
def number_text_lines(spark, sf_dir):
    """Lines of a text column."""
    return views.corpus(spark, sf_dir).select("file", "line_no", "raw")


@query(f"WITH {views.NUMBERED} SELECT '2024-01-31' AS run_date, raw FROM l WHERE event_type = 'error'")
def archive_raw_lines(spark, sf_dir):
    """Matched lines as compressed text below a dated folder, read back."""
    path = f"{checkpoint_dir(spark)}/archive-{uuid.uuid4().hex}"
    found = views.lines(spark, sf_dir).filter(Patterns.of(r"error\[").selects())
    to_directory(path, "text", dt.date(2024, 1, 31), gzip=True)(found)
    back = spark.read.text(path)
    return back.select(F.col("run_date").cast("string").alias("run_date"), F.col("value").alias("raw"))


@query(
    f"""WITH {views.NUMBERED} SELECT raw, count(*) AS copies FROM l
    WHERE event_type = 'error' AND k BETWEEN 40 AND 49 GROUP BY raw"""
)
def stream_pattern_search(spark, sf_dir):
    """The search as a stream over text files; all available files are taken."""
    stream = read_line_stream(spark, f"{_written(spark, sf_dir)}/*")
    found = stream.filter(Patterns.of(r"error\[\d+\]: k=4\d ").selects()).select("raw")
    out = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = (
        found.writeStream.format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema("raw string").parquet(f"{out}/data").groupBy("raw").agg(
        F.count(F.lit(1)).alias("copies")
    )


@query(
    f"""WITH {views.NUMBERED} SELECT 'json' AS channel, '2024-01-31' AS run_date, raw FROM l WHERE event_type = 'error'
    UNION ALL SELECT 'text', '2024-01-31', raw FROM l WHERE event_type = 'error'"""
)
def write_all(spark, sf_dir):
    """One result to two channels, read back."""
    path = f"{checkpoint_dir(spark)}/all-{uuid.uuid4().hex}"
    found = views.lines(spark, sf_dir).filter(Patterns.of(r"error\[").selects()).select("file", "raw")
    day = dt.date(2024, 1, 31)
    sinks.write_all(found, [to_directory(f"{path}/{fmt}", fmt, day) for fmt in ("json", "text")])
    schemas = {"json": "raw string, run_date string", "text": "value string, run_date string"}
    one, two = (spark.read.format(f).schema(schemas[f]).load(f"{path}/{f}").toDF("raw", "run_date").withColumn("channel", F.lit(f)) for f in schemas)
    return one.union(two).select("channel", "run_date", "raw")


@query(
    f"""WITH {views.NUMBERED} SELECT 'errors' AS stream, raw, count(*) AS copies FROM l WHERE event_type = 'error' GROUP BY raw
    UNION ALL SELECT 'signups', raw, count(*) FROM l WHERE event_type = 'signup' GROUP BY raw"""
)
def stream_to(spark, sf_dir):
    """Two streams into one folder, one of them started twice: each line is written once."""
    lines, path = f"{_written(spark, sf_dir)}/*", f"{checkpoint_dir(spark)}/streams-{uuid.uuid4().hex}"
    target = to_directory(path, "parquet", dt.date(2024, 1, 31))
    for name, tag in (("errors", "error"), ("signups", "signup"), ("errors", "error")):
        found = read_line_stream(spark, lines).filter(Patterns.of(rf"{tag}\[").selects()).select("raw")
        streaming.stream_to(found, [target], f"{name}-{path.rsplit('-', 1)[1]}").awaitTermination()
    back = spark.read.schema("raw string, run_date string, stream string, batch int").parquet(path)
    stream = F.substring_index("stream", "-", 1).alias("stream")
    return back.groupBy(stream, "raw").agg(F.count(F.lit(1)).alias("copies"))
