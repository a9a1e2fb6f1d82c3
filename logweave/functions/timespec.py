"""Time specifications: ``--date`` and ``--last`` style periods, time ranges, date paths."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Period = tuple[dt.datetime | None, dt.datetime | None]

# Seconds per unit of a "last" specification (a month is 30 days).
UNIT_SECONDS = {"h": 3600, "d": 86400, "w": 604800, "m": 2592000}


def last_seconds(spec: str) -> int:
    """``hour``, ``day``, ``week``, ``month`` or ``<n>h|d|w|m`` as seconds."""
    if not isinstance(spec, str):
        raise TypeError("a last period must be a string")
    spec = {"hour": "1h", "day": "1d", "week": "1w", "month": "1m"}.get(spec, spec)
    match = re.fullmatch(r"\+?([0-9]+)([hdwmHDWM])", spec)
    if not match or int(match[1]) == 0:
        raise ValueError(f"invalid last period {spec!r}")
    return int(match[1]) * UNIT_SECONDS[match[2].lower()]


def last_period(spec: str, now: dt.datetime | None = None) -> Period:
    """From ``spec`` before now up to one hour after now."""
    now = now or dt.datetime.now()
    return now - dt.timedelta(seconds=last_seconds(spec)), now + dt.timedelta(hours=1)


def date_period(spec: str, today: dt.date | None = None) -> Period:
    """``[YYYY]MMDD[,[YYYY]MMDD]``: first day 00:00:00 to last day 23:59:59."""
    spec = spec.strip()
    if not re.fullmatch(r"[0-9]{4}|[0-9]{8}|[0-9]{4},[0-9]{4}|[0-9]{8},[0-9]{8}", spec):
        raise ValueError(f"invalid date period {spec!r}, use [YYYY]MMDD[,[YYYY]MMDD]")
    year = f"{(today or dt.date.today()).year:04d}"
    days = []
    for part in spec.split(","):
        text = part if len(part) == 8 else year + part
        try:
            days.append(dt.datetime.strptime(text, "%Y%m%d"))
        except ValueError:
            raise ValueError(f"invalid date {part!r} in {spec!r}") from None
    start, end = days[0], days[-1] + dt.timedelta(hours=23, minutes=59, seconds=59)
    if start > end:
        raise ValueError(f"the first date is after the second in {spec!r}")
    return start, end


@dataclass(frozen=True)
class TimeRange:
    """Time of day from ``start`` to the end of minute ``end``, both ``HH:MM``."""

    start: str
    end: str

    @classmethod
    def parse(cls, spec: str) -> TimeRange:
        parts = [p.strip() for p in spec.split(",")]
        if len(parts) != 2:
            raise ValueError(f"{spec!r} is not a time range, use HH:MM,HH:MM")
        start, end = (dt.datetime.strptime(p, "%H:%M").strftime("%H:%M") for p in parts)
        if start == end:
            raise ValueError("start and end times must be different")
        return cls(start, end)

    def contains(self, ltime: Column, wrap: bool = False) -> Column:
        minute = F.substring(ltime, 1, 5)
        if wrap and self.start > self.end:
            return (minute >= self.start) | (minute <= self.end)
        return minute.between(self.start, self.end)


# The date tokens a path may hold, as Spark date formats.
DATE_TOKENS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%j": "DDD",
    "%a": "EEE", "%A": "EEEE", "%b": "MMM", "%B": "MMMM",
}


def date_path(template: str, day: Column) -> Column:
    """Path of a template such as ``/var/log/%Y/%m/app-%Y%m%d.log`` on a given day."""
    parts = []
    for text in re.split(r"(%.)", template):
        if text in DATE_TOKENS:
            parts.append(F.date_format(day, DATE_TOKENS[text]))
        elif text == "%w":
            parts.append((F.dayofweek(day) - 1).cast("string"))
        elif text:
            parts.append(F.lit("%" if text == "%%" else text))
    return F.concat(*parts) if parts else F.lit("")


def host_path(template: Column, host: Column) -> Column:
    """Fill ``${host}`` in a path template."""
    return F.replace(template, F.lit("${host}"), host)


def expand_paths(spark, templates: list[str], period: Period, hosts: list[str] = ()) -> DataFrame:
    """All distinct paths of date and host templates over the days of a period."""
    start, end = period
    if start is None:
        # no period: date tokens stay as they are
        paths = [(t,) for t in templates]
        out = spark.createDataFrame(paths, "path string")
    else:
        end = end or dt.datetime.now()
        if start > end:
            raise ValueError(f"the period starts after its end: {period}")
        days = spark.range(1).select(
            F.explode(
                F.sequence(F.lit(start.date()), F.lit(end.date()), F.expr("interval 1 day"))
            ).alias("day")
        )
        out = days.select(
            F.explode(F.array(*[date_path(t, F.col("day")) for t in templates])).alias("path")
        )
    names = F.explode(F.array(*[F.lit(h) for h in (hosts or ["*"])]))
    return (
        out.select("path", names.alias("host"))
        .select(host_path(F.col("path"), F.col("host")).alias("path"))
        .distinct()
    )
