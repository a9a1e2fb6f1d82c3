"""Syslog header parsing, format detection and event time."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.regex import JavaRegex, captures_sql, compute_once, to_java
from logweave.operators.joins import join_checked

# Columns a header may give, in output order, with their types.
HEADER_COLUMNS = {
    "pri": "int", "ver": "string", "year": "int", "month": "int", "day": "int",
    "ltime": "string", "secfrac": "string", "offset": "string", "host": "string",
    "apptag": "string", "procid": "string", "msgid": "string", "repeat": "int",
    "message": "string",
}

# Month names of RFC 3164.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@dataclass(frozen=True)
class HeaderFormat:
    """A named header pattern.  ``app`` binds all its lines to one application."""

    name: str
    pattern: str
    app: str | None = None

    def __post_init__(self):
        found = {g.name for g in self.regex.groups}
        missing = {"month", "day", "ltime", "message"} - found
        if missing:
            raise ValueError(f"header format {self.name!r} lacks groups {sorted(missing)}")
        extra = found - set(HEADER_COLUMNS)
        if extra:
            raise ValueError(f"header format {self.name!r} has unknown groups {sorted(extra)}")

    @cached_property
    def regex(self) -> JavaRegex:
        return to_java(self.pattern)


_CLOCK = r"(?P<ltime>[0-9]{2}:[0-9]{2}:[0-9]{2})"

_PRI = r"<(?P<pri>0|[1-9][0-9]{0,2})>"  # PRIVAL, without leading zeros

# RFC 3164 section 4.1.  TIMESTAMP is "Mmm dd hh:mm:ss" with a blank before a day of one digit; a
# relay may have dropped PRI.  MSG is TAG, of alphanumeric characters up to the first other one in the
# usual daemons' way, and CONTENT.  The notice of repetitions has neither HOSTNAME nor TAG.
_STAMP = "(?P<month>" + "|".join(MONTHS) + r") (?P<day> [1-9]|[12][0-9]|3[01]) " + _CLOCK
_NOTICE = "last message repeated (?P<repeat>[0-9]+) times"
_MSG = r"(?P<message>(?P<apptag>[^\s\[(:]{1,32}).*)"
RFC3164 = HeaderFormat("rfc3164", rf"(?:{_PRI})?{_STAMP} (?:{_NOTICE}|(?P<host>\S+)\s+{_MSG})")


def _field(name: str, most: int) -> str:
    """RFC 5424 section 6: SP and a value of printable ASCII, or NILVALUE."""
    return rf" (?:-(?= )|(?P<{name}>[!-~]{{1,{most}}}))"


# VERSION is NONZERO-DIGIT 0*2DIGIT.  TIMESTAMP is a whole date and time or NILVALUE.  What follows the
# fields (STRUCTURED-DATA and MSG) is the message.  A relay may have dropped PRI and VERSION.
_DATE_TIME = (
    r"(?P<year>[0-9]{4})-(?P<month>0[1-9]|1[0-2])-(?P<day>0[1-9]|[12][0-9]|3[01])T" + _CLOCK
    + r"(?:\.(?P<secfrac>[0-9]{1,6}))?(?:Z|(?P<offset>[-+][0-9]{2}:[0-9]{2}))"
)
RFC5424 = HeaderFormat(
    "rfc5424",
    rf"(?:{_PRI}(?P<ver>[1-9][0-9]{{0,2}}) )?(?:-(?= )|{_DATE_TIME})"
    + _field("host", 255) + _field("apptag", 48) + _field("procid", 128) + _field("msgid", 32)
    + " (?P<message>.*)",
)

BUILT_IN = (RFC3164, RFC5424)


def parse_headers(
    lines: DataFrame,
    formats: tuple[HeaderFormat, ...] = BUILT_IN,
    use_offset: bool = False,
    reference: Column | None = None,
) -> DataFrame:
    """Add ``format``, the header columns and ``event_ts`` to raw lines.

    Formats are tried in order; each costs at most one regex run per line, and all
    write the same columns in the same places.  ``reference`` is the date that a
    header without a year counts from (``file_mtime`` by default).  ``format`` is
    null on lines of unknown format.
    """
    written = []
    for fmt in formats:
        groups = {g.name: f"${g.index}" for g in fmt.regex.groups}
        text = [fmt.name, *[groups.get(name, "") for name in HEADER_COLUMNS]]
        written.append((fmt.regex, "\n".join(text)))
    # a log line holds no line feed: a text with one is of unknown format
    found = f"CASE WHEN contains(raw, chr(10)) THEN array('') ELSE {captures_sql('raw', written, anchored=True)} END"
    head = compute_once(lines, "_head", found)
    kept = [f"`{c}`" for c in lines.columns]
    known = "size(_head) > 1"
    columns = [f"CASE WHEN {known} THEN get(_head, 0) END AS format"]
    for place, (name, kind) in enumerate(HEADER_COLUMNS.items(), 1):
        value = f"nullif(get(_head, {place}), '')"
        if name == "month":
            value = _MONTH.format(f"get(_head, {place})")
        elif name == "message":
            # a message may be empty, a notice of repetition has none
            repeat = list(HEADER_COLUMNS).index("repeat") + 1
            value = f"CASE WHEN get(_head, {repeat}) = '' THEN get(_head, {place}) END"
        elif kind != "string":
            value = f"try_cast({value} AS {kind})"
        columns.append(f"{value} AS `{name}`")
    if any(f.app for f in formats):
        cases = " ".join(f"WHEN '{f.name}' THEN '{f.app}'" for f in formats if f.app)
        columns.append(f"CASE get(_head, 0) {cases} END AS format_app")
    df = head.selectExpr(*kept, *columns)
    if reference is None:
        reference = F.col("file_mtime")
    return df.withColumn("event_ts", event_time(reference, use_offset))


# Month names and two-digit numbers as a number; null for anything else.
_MONTH = (
    "map("
    + ", ".join(f"'{m}', {i}, '{i:02d}', {i}" for i, m in enumerate(MONTHS, 1))
    + ")[{0}]"
)


def event_time(reference: Column, use_offset: bool = False) -> Column:
    """Naive time of the event, null if the header holds no valid date.

    A header without a year takes the year of ``reference``, or the one before
    when the reference lies in January and the header does not.  The fraction is
    ignored; the offset too, unless ``use_offset`` moves the time to UTC.
    """
    before = (F.month(reference) == 1) & (F.col("month") != 1)
    assumed = F.year(reference) - F.when(before, 1).otherwise(0)
    hour, minute, second = (F.expr(f"CAST(substr(ltime, {i}, 2) AS INT)") for i in (1, 4, 7))
    ts = F.try_make_timestamp_ntz(
        F.coalesce("year", assumed), F.col("month"), F.col("day"), hour, minute, second
    )
    if not use_offset:
        return ts
    minutes = "CAST(substr(offset, 2, 2) AS INT) * 60 + CAST(substr(offset, 5, 2) AS INT)"
    signed = f"CASE WHEN offset LIKE '-%' THEN -({minutes}) ELSE {minutes} END"
    return ts - F.expr(f"make_interval(0, 0, 0, 0, 0, coalesce({signed}, 0))")


def known_lines(parsed: DataFrame, skip_unknown_files: bool = True) -> DataFrame:
    """Lines of a known format.

    With ``skip_unknown_files`` a file whose first line is of unknown format is
    left out as a whole.
    """
    known = parsed.filter(F.col("format").isNotNull())
    if not skip_unknown_files:
        return known
    return join_checked(known, unknown_files(parsed), ["file"], "left_anti")


def unknown_files(parsed: DataFrame) -> DataFrame:
    """Files whose first line is of unknown format."""
    return parsed.filter((F.col("line_no") == 1) & F.col("format").isNull()).select("file")


def file_counts(parsed: DataFrame, skip_unknown_files: bool = True, *more: Column) -> DataFrame:
    """Per file: lines read and lines of unknown format, and ``more`` aggregates.

    A file of unknown format counts as one line read and none unknown.
    """
    # only skipping needs line numbers
    first = F.col("line_no") == 1 if skip_unknown_files else F.lit(False)
    bad_first = first & F.col("format").isNull()
    counts = parsed.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("format").isNull()).alias("unknown"),
        F.bool_or(bad_first).alias("skipped"),
        *more,
    )
    return counts.withColumn("lines", F.when(F.col("skipped"), 1).otherwise(F.col("lines"))).withColumn(
        "unknown", F.when(F.col("skipped"), 0).otherwise(F.col("unknown"))
    )
