"""Log lines made from the driver's tables, in Spark and as SQL.

Every event becomes one line.  ``EVENTS`` is the common base: the SQL checks use
its columns directly, while the Spark side has only the text of the line.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave import from_table, from_text_column
from logweave.operators.joins import spread

# All events lie in January 2024.
REFERENCE = "2024-01-31 00:00:00"

EVENTS = """
e AS (SELECT event_id, ts, user_id, event_type, user_id % 7 AS h,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
             CAST(floor(value) AS BIGINT) AS v,
             CAST(date_trunc('second', ts) AS TIMESTAMP) AS sec,
             'day-' || strftime(ts, '%Y%m%d') AS file
      FROM events)"""

# The line of an event, given its tag and message, and its place in its file.
NUMBERED = EVENTS + """,
l AS (SELECT e.*, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) AS line_no,
             strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || ' '
             || strftime(ts, '%H:%M:%S') || ' host' || h || ' ' || event_type || '[' || user_id
             || ']: k=' || k || ' v=' || v AS raw
      FROM e)"""

CORPUS = """
c AS (SELECT doc_id, lang, CAST(doc_id AS VARCHAR) AS file,
             unnest(string_split(text, chr(10))) AS raw,
             generate_subscripts(string_split(text, chr(10)), 1) AS line_no
      FROM documents)"""

SYSLOG_TEXT = "event_type || '[' || user_id || ']: k=' || k || ' v=' || v"

_numbered: dict[tuple[str, str, str], DataFrame] = {}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "user_id % 7 AS h",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        "CAST(floor(value) AS BIGINT) AS v",
        "concat('day-', date_format(ts, 'yyyyMMdd')) AS file",
    )


def stamped(message: str, ts: str = "ts") -> str:
    """SQL text of a line in the style of RFC 3164."""
    return (
        f"date_format({ts}, 'MMM') || ' ' || lpad(CAST(day({ts}) AS STRING), 2, ' ') || ' '"
        f" || date_format({ts}, 'HH:mm:ss') || ' host' || h || ' ' || {message}"
    )


def lines(
    spark: SparkSession,
    sf_dir: str,
    message: str = SYSLOG_TEXT,
    raw: str | None = None,
    reference: str = REFERENCE,
    keep: tuple[str, ...] = ("event_id",),
) -> DataFrame:
    """Lines without numbers: nothing is shuffled."""
    return from_table(
        events(spark, sf_dir),
        "file",
        F.expr(raw or stamped(message)),
        F.lit(reference),
        keep=list(keep),
    )


def numbered(spark: SparkSession, sf_dir: str, message: str = SYSLOG_TEXT, raw: str | None = None) -> DataFrame:
    """The same lines numbered in time order within each day, once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, raw or message)
    if key not in _numbered:
        _numbered[key] = from_table(
            events(spark, sf_dir),
            "file",
            F.expr(raw or stamped(message)),
            F.lit(REFERENCE),
            order=["ts", "event_id"],
            keep=["event_id"],
        )
    return _numbered[key]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of documents; a document is a file."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    return from_text_column(docs, "doc_id", "text", F.lit(REFERENCE), keep=["doc_id", "lang"])


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations; a conversation is a file, a role a thread."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    out = from_table(
        turns, "conv_id", "text", F.lit(REFERENCE), line_no=F.col("turn") + 1, keep=["conv_id", "role"]
    )
    return out.withColumnsRenamed({"role": "thread"}).withColumn("app", F.lit("chat"))


def when(start: str, end: str) -> tuple[dt.datetime, dt.datetime]:
    return dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end)
