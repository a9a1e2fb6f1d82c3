"""Header parsing and event time."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query
from logweave import HeaderFormat
from logweave.operators.headers import file_counts, known_lines, parse_headers

_RFC5424 = (
    "'<' || (k + 1) || '>1 ' || date_format(ts, 'yyyy-MM-dd') || 'T' || date_format(ts, 'HH:mm:ss')"
    " || '.' || lpad(CAST(k AS STRING), 3, '0') || CASE WHEN h % 2 = 0 THEN 'Z' ELSE '+02:00' END"
    " || ' ' || CASE WHEN h = 3 THEN '-' ELSE 'host' || h || '.example.com' END"
    " || ' ' || event_type || ' ' || user_id || ' - ' || 'v=' || v"
)
# one line of ten is of no known format
_MIXED = (
    f"CASE WHEN event_id % 10 = 9 THEN 'noise ' || v WHEN event_id % 2 = 0 THEN {_RFC5424} "
    f"ELSE {views.stamped(views.SYSLOG_TEXT)} END"
)


@query(
    f"""WITH {views.EVENTS}
    SELECT event_id, 'Jan' AS month, CAST(day(ts) AS INTEGER) AS day, strftime(ts, '%H:%M:%S') AS ltime,
           'host' || h AS host, event_type AS apptag, CAST(k AS INTEGER) AS pri,
           event_type || '[' || user_id || ']: k=' || k || ' v=' || v AS message FROM e"""
)
def parse_rfc3164(spark, sf_dir):
    raw = f"'<' || k || '>' || {views.stamped(views.SYSLOG_TEXT)}"
    parsed = parse_headers(views.lines(spark, sf_dir, raw=raw))
    return parsed.select(
        "event_id", F.date_format(F.make_date(F.lit(2024), "month", "day"), "MMM").alias("month"),
        "day", "ltime", "host", "apptag", "pri", "message",
    )


@query(
    f"""WITH {views.EVENTS}
    SELECT event_id, CAST(k + 1 AS INTEGER) AS pri, '1' AS ver, CAST(year(ts) AS INTEGER) AS year,
           CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
           strftime(ts, '%H:%M:%S') AS ltime, lpad(CAST(k AS VARCHAR), 3, '0') AS secfrac,
           CASE WHEN h % 2 <> 0 THEN '+02:00' END AS "offset",
           CASE WHEN h <> 3 THEN 'host' || h || '.example.com' END AS host, event_type AS apptag,
           CAST(user_id AS VARCHAR) AS procid, CAST(NULL AS VARCHAR) AS msgid, 'v=' || v AS message FROM e"""
)
def parse_rfc5424(spark, sf_dir):
    parsed = parse_headers(views.lines(spark, sf_dir, raw=_RFC5424))
    return parsed.select(
        "event_id", "pri", "ver", "year", "month", "day", "ltime", "secfrac", "offset", "host",
        "apptag", "procid", "msgid", "message",
    )


@query(
    f"""WITH {views.EVENTS}
    SELECT CASE WHEN event_id % 10 = 9 THEN 'unknown' WHEN event_id % 2 = 0 THEN 'rfc5424'
                ELSE 'rfc3164' END AS format, count(*) AS lines FROM e GROUP BY 1"""
)
def detect_formats(spark, sf_dir):
    parsed = parse_headers(views.lines(spark, sf_dir, raw=_MIXED))
    name = F.coalesce("format", F.lit("unknown")).alias("format")
    return parsed.groupBy(name).agg(F.count(F.lit(1)).alias("lines"))


@query(
    f"""WITH {views.EVENTS}
    SELECT event_type AS apptag, 'host' || h AS host, count(*) AS lines, min(sec) AS first_event
    FROM e GROUP BY 1, 2"""
)
def parse_custom_format(spark, sf_dir):
    """A header format of the user's own."""
    raw = (
        "'[' || date_format(ts, 'dd/MM/yyyy HH:mm:ss') || '] {host' || h || '} ' || event_type"
        " || ' k=' || k"
    )
    own = HeaderFormat(
        "own",
        r"\[(?P<day>\d\d)/(?P<month>\d\d)/(?P<year>\d{4}) (?P<ltime>[\d:]{8})\] "
        r"\{(?P<host>[^}]+)\} (?P<message>(?P<apptag>\w+).*)",
    )
    parsed = parse_headers(views.lines(spark, sf_dir, raw=raw), (own,))
    return parsed.groupBy("apptag", "host").agg(
        F.count(F.lit(1)).alias("lines"), F.min("event_ts").alias("first_event")
    )


_FIRST = """,
f AS (SELECT file, min(CASE WHEN line_no = 1 THEN event_id % 10 END) = 9 AS skipped FROM l GROUP BY file)"""


@query(
    f"""WITH {views.NUMBERED}{_FIRST}
    SELECT l.file, CASE WHEN any_value(f.skipped) THEN 1 ELSE count(*) END AS lines,
           CASE WHEN any_value(f.skipped) THEN 0 ELSE count(*) FILTER (WHERE event_id % 10 = 9) END AS unknown,
           any_value(f.skipped) AS skipped
    FROM l JOIN f USING (file) GROUP BY l.file"""
)
def count_unknown_lines(spark, sf_dir):
    """A file that begins with an unknown line counts one line and is skipped."""
    return file_counts(parse_headers(views.numbered(spark, sf_dir, raw=_MIXED)))


@query(
    f"""WITH {views.NUMBERED}{_FIRST}
    SELECT l.file, l.line_no, l.event_id FROM l JOIN f USING (file)
    WHERE NOT f.skipped AND event_id % 10 <> 9"""
)
def skip_unknown_files(spark, sf_dir):
    parsed = parse_headers(views.numbered(spark, sf_dir, raw=_MIXED))
    return known_lines(parsed).select("file", "line_no", "event_id")


@query(f"WITH {views.EVENTS} SELECT event_id, sec AS event_ts FROM e")
def event_time(spark, sf_dir):
    return parse_headers(views.lines(spark, sf_dir)).select("event_id", "event_ts")


@query(f"WITH {views.EVENTS} SELECT event_id, sec - INTERVAL 17 DAY AS event_ts FROM e")
def event_time_around_new_year(spark, sf_dir):
    """Lines of December and January in files of January: the first belong to the year before."""
    raw = views.stamped(views.SYSLOG_TEXT, "(ts - interval 17 days)")
    lines = views.lines(spark, sf_dir, raw=raw, reference="2024-01-14 12:00:00")
    return parse_headers(lines).select("event_id", "event_ts")


@query(
    f"""WITH {views.EVENTS}
    SELECT event_id, CASE WHEN h % 2 = 0 THEN sec ELSE sec - INTERVAL 2 HOUR END AS event_ts FROM e"""
)
def event_time_with_offset(spark, sf_dir):
    parsed = parse_headers(views.lines(spark, sf_dir, raw=_RFC5424), use_offset=True)
    return parsed.select("event_id", "event_ts")
