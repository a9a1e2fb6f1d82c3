"""Scope filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from catalog import apps, views
from catalog.registry import query
from logweave.functions.timespec import date_period, last_period
from logweave.operators.headers import parse_headers
from logweave.operators.rules import apply_rules
from logweave.operators.scope import in_period, in_time_range, of_apps, on_hosts, until_newer


def _events(spark, sf_dir, **options):
    return parse_headers(views.lines(spark, sf_dir, **options))


@query(
    f"""WITH {views.EVENTS} SELECT event_id, sec AS event_ts FROM e
    WHERE sec BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-12 18:30:00'"""
)
def filter_period(spark, sf_dir):
    period = views.when("2024-01-05 06:00:00", "2024-01-12 18:30:00")
    return in_period(_events(spark, sf_dir), period).select("event_id", "event_ts")


@query(
    f"""WITH {views.EVENTS} SELECT event_id FROM e
    WHERE sec BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 23:59:59'"""
)
def filter_date_spec(spark, sf_dir):
    return in_period(_events(spark, sf_dir), date_period("20240110,20240112")).select("event_id")


@query(
    f"""WITH {views.EVENTS} SELECT event_id FROM e
    WHERE sec BETWEEN TIMESTAMP '2024-01-13 12:00:00' AND TIMESTAMP '2024-01-27 13:00:00'"""
)
def filter_last_spec(spark, sf_dir):
    period = last_period("2w", now=dt.datetime(2024, 1, 27, 12))
    return in_period(_events(spark, sf_dir), period).select("event_id")


@query(
    f"""WITH {views.EVENTS} SELECT event_id FROM e
    WHERE strftime(ts, '%H:%M') BETWEEN '08:00' AND '10:59'"""
)
def filter_time_range(spark, sf_dir):
    return in_time_range(_events(spark, sf_dir), "08:00,10:59").select("event_id")


@query(
    f"""WITH {views.EVENTS} SELECT event_id FROM e
    WHERE strftime(ts, '%H:%M') >= '22:30' OR strftime(ts, '%H:%M') <= '01:15'"""
)
def filter_time_range_over_midnight(spark, sf_dir):
    return in_time_range(_events(spark, sf_dir), "22:30,01:15", wrap=True).select("event_id")


@query(
    f"""WITH {views.NUMBERED} SELECT l.file, l.line_no, l.event_id FROM l
    WHERE NOT EXISTS (SELECT 1 FROM l AS n WHERE n.file = l.file AND n.line_no <= l.line_no
                      AND n.sec > TIMESTAMP '2024-01-05 06:00:00' AND n.file = 'day-20240105')
      AND l.file <= 'day-20240105'"""
)
def stop_at_newer_line(spark, sf_dir):
    parsed = parse_headers(views.numbered(spark, sf_dir))
    return until_newer(parsed, dt.datetime(2024, 1, 5, 6)).select("file", "line_no", "event_id")


@query(f"WITH {views.EVENTS} SELECT event_id, 'host' || h AS host FROM e WHERE h IN (1, 2, 3, 5)")
def filter_hosts(spark, sf_dir):
    """Globs are alternatives; ``host5.example.com`` also stands for ``host5``."""
    kept = on_hosts(_events(spark, sf_dir), ["host[1-3]", "host5.example.com"])
    return kept.select("event_id", "host")


@query(
    f"""WITH {views.EVENTS} SELECT event_id, CASE event_type WHEN 'error' THEN 'trouble' ELSE 'shop' END AS app
    FROM e WHERE event_type IN ('purchase', 'signup', 'error')"""
)
def filter_apps(spark, sf_dir):
    parsed = apply_rules(_events(spark, sf_dir), apps.ALL)
    return of_apps(parsed, ["shop", "trouble"]).select("event_id", F.col("app"))
