"""Scope filters: period, time of day, host, application."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.globs import any_of, matches_any
from logweave.functions.timespec import Period, TimeRange
from logweave.operators.joins import join_checked


def _naive(moment: dt.datetime) -> Column:
    return F.lit(moment.replace(microsecond=0, tzinfo=None).isoformat(" ")).cast("timestamp_ntz")


def period_holds(period: Period) -> Column:
    """Whether an event lies within the period, ends included; false without a time.

    One ``BETWEEN``, so that the time is worked out once.
    """
    start = _naive(period[0] or dt.datetime(1, 1, 1))
    end = _naive(period[1] or dt.datetime(9999, 12, 31, 23, 59, 59))
    return F.coalesce(F.col("event_ts").between(start, end), F.lit(False))


def in_period(events: DataFrame, period: Period) -> DataFrame:
    """Events within the period; an event without time is left out."""
    return events.filter(period_holds(period))


def until_newer(events: DataFrame, end: dt.datetime) -> DataFrame:
    """Stop every file at its first line newer than ``end``.

    The cut line of a file is a plain minimum, so no file is sorted or windowed.
    """
    newer = F.when(F.col("event_ts") > _naive(end), F.col("line_no"))
    cuts = events.groupBy("file").agg(F.min(newer).alias("_cut")).filter("_cut is not null")
    kept = join_checked(events, cuts, ["file"], "left")
    return kept.filter(F.col("_cut").isNull() | (F.col("line_no") < F.col("_cut"))).drop("_cut")


def in_time_range(events: DataFrame, time_range: TimeRange | str, wrap: bool = False) -> DataFrame:
    if isinstance(time_range, str):
        time_range = TimeRange.parse(time_range)
    return events.filter(time_range.contains(F.col("ltime"), wrap))


def host_matches(globs: list[str]) -> Column:
    """True for hosts that match one glob, and for lines without a host.

    A dotted glob also accepts its own first label, unless that holds a ``*``.
    """
    wanted = []
    for glob in globs:
        wanted.append(glob)
        label = glob.split(".")[0]
        if "." in glob and label and "*" not in label:
            wanted.append(label)
    if "*" in wanted:
        return F.lit(True)
    host = F.col("host")
    return any_of([host.isNull(), matches_any(host, wanted)])


def on_hosts(events: DataFrame, globs: list[str]) -> DataFrame:
    return events.filter(host_matches(globs)) if globs else events


def of_apps(parsed: DataFrame, apps: list[str]) -> DataFrame:
    return parsed.filter(F.col("app").isin(list(apps)))
