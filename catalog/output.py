"""Line outputs, limits, context and threads."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import apps, views
from catalog.registry import query
from logweave.operators import output
from logweave.operators.headers import parse_headers
from logweave.operators.rules import apply_rules
from logweave.operators.search import Patterns
from logweave.plans.search import LogSearch

_ERRORS = Patterns.of(r"error\[\d+\]: k=4\d ")
_IS_ERROR = "event_type = 'error' AND k BETWEEN 40 AND 49"


def _parsed(spark, sf_dir):
    return parse_headers(views.numbered(spark, sf_dir))


@query(f"WITH {views.NUMBERED} SELECT file, line_no, raw FROM l WHERE {_IS_ERROR}")
def selected_lines(spark, sf_dir):
    """Selected lines in file and line order."""
    run = LogSearch(patterns=_ERRORS, apps=apps.ALL)
    found = run.select(views.numbered(spark, sf_dir))
    return output.sorted_lines(found.select("file", "line_no", "raw"))


@query(
    f"""WITH {views.CORPUS} SELECT file, count(*) FILTER (WHERE regexp_matches(raw, 'thaner')) AS matches
    FROM c GROUP BY file"""
)
def count_per_file(spark, sf_dir):
    return output.count_per_file(views.corpus(spark, sf_dir), Patterns.of("thaner").selects())


@query(f"WITH {views.CORPUS} SELECT DISTINCT file FROM c WHERE regexp_matches(raw, 'thaner')")
def files_with_match(spark, sf_dir):
    return output.files_with_match(views.corpus(spark, sf_dir), Patterns.of("thaner").selects())


@query(
    f"""WITH {views.CORPUS} SELECT file FROM c GROUP BY file
    HAVING count(*) FILTER (WHERE regexp_matches(raw, 'thaner')) = 0"""
)
def files_without_match(spark, sf_dir):
    return output.files_without_match(views.corpus(spark, sf_dir), Patterns.of("thaner").selects())


@query(
    f"""WITH {views.NUMBERED} SELECT file, line_no, raw FROM l WHERE event_type = 'error'
    QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no) <= 5"""
)
def max_count_per_file(spark, sf_dir):
    found = views.numbered(spark, sf_dir).filter(Patterns.of(r"error\[").selects())
    return output.max_count(found, 5).select("file", "line_no", "raw")


@query(f"WITH {views.CORPUS} SELECT bool_or(regexp_matches(raw, 'thaner')) AS any_match FROM c")
def any_match(spark, sf_dir):
    return output.any_match(views.corpus(spark, sf_dir), Patterns.of("thaner").selects())


_CONTEXT = f"""WITH {views.NUMBERED},
s AS (SELECT *, {_IS_ERROR} AS sel, row_number() OVER (PARTITION BY file ORDER BY line_no) AS pos
      FROM l WHERE h <> 2),
n AS (SELECT *, max(CASE WHEN sel THEN pos END) OVER (PARTITION BY file ORDER BY pos) AS prev,
             min(CASE WHEN sel THEN pos END) OVER (PARTITION BY file ORDER BY pos DESC) AS next FROM s),
x AS (SELECT *, CASE WHEN sel THEN 'match' ELSE 'context' END AS kind FROM n
      WHERE pos - prev <= 1 OR next - pos <= 2)"""


def _context(spark, sf_dir):
    """Two lines before and one after, among the lines of all hosts but one."""
    scope = _parsed(spark, sf_dir).filter("host <> 'host2'")
    return output.context(scope, _ERRORS.selects(), before=2, after=1)


@query(f"{_CONTEXT} SELECT file, line_no, kind, raw FROM x")
def context_lines(spark, sf_dir):
    return _context(spark, sf_dir).select("file", "line_no", "kind", "raw")


@query(
    f"""{_CONTEXT},
    y AS (SELECT *, lag(line_no) OVER (PARTITION BY file ORDER BY line_no) AS before FROM x)
    SELECT file, line_no,
           CAST(sum(CASE WHEN before IS NULL OR line_no - before > 1 THEN 1 ELSE 0 END)
                OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS group_no,
           before IS NOT NULL AND line_no - before > 1 AS separator
    FROM y"""
)
def context_groups(spark, sf_dir):
    groups = output.context_groups(_context(spark, sf_dir))
    return groups.select("file", "line_no", "group_no", "separator")


_THREADS = f"""WITH {views.NUMBERED},
t AS (SELECT *, {_IS_ERROR} AS sel, CASE event_type WHEN 'error' THEN 'trouble' WHEN 'purchase' THEN 'shop'
             WHEN 'signup' THEN 'shop' ELSE 'web' END AS app
      FROM l WHERE event_type <> 'view' OR k < 50),
p AS (SELECT *, row_number() OVER (PARTITION BY file, app, user_id ORDER BY line_no) AS pos FROM t),
n AS (SELECT *, max(CASE WHEN sel THEN pos END) OVER (PARTITION BY file, app, user_id ORDER BY pos) AS prev,
             min(CASE WHEN sel THEN pos END) OVER (PARTITION BY file, app, user_id ORDER BY pos DESC) AS next
      FROM p)"""


def _ruled(spark, sf_dir):
    return apply_rules(_parsed(spark, sf_dir), apps.ALL).filter("matched")


@query(
    f"""{_THREADS} SELECT file, line_no, app, CAST(user_id AS VARCHAR) AS thread,
        CASE WHEN sel THEN 'match' ELSE 'context' END AS kind
    FROM n WHERE pos - prev <= 1 OR next - pos <= 1"""
)
def thread_context(spark, sf_dir):
    near = output.thread_context(_ruled(spark, sf_dir), _ERRORS.selects(), before=1, after=1)
    return near.select("file", "line_no", "app", "thread", "kind")


@query(
    f"""{_THREADS} SELECT file, line_no, app, CAST(user_id AS VARCHAR) AS thread FROM t
    WHERE EXISTS (SELECT 1 FROM t AS o WHERE o.sel AND o.file = t.file AND o.app = t.app AND o.user_id = t.user_id)"""
)
def whole_threads(spark, sf_dir):
    found = output.whole_threads(_ruled(spark, sf_dir), _ERRORS.selects())
    return found.select("file", "line_no", "app", "thread")


@query(
    """SELECT CAST(conv_id AS VARCHAR) AS file, CAST(turn + 1 AS BIGINT) AS line_no, role AS thread
    FROM conversations AS c
    WHERE EXISTS (SELECT 1 FROM conversations AS o WHERE o.conv_id = c.conv_id AND o.role = c.role
                  AND regexp_matches(o.text, 'th[a-z]+ing'))"""
)
def whole_threads_of_chats(spark, sf_dir):
    turns = views.chat(spark, sf_dir)
    found = output.whole_threads(turns, Patterns.of("th[a-z]+ing").selects())
    return found.select("file", "line_no", "thread")


@query(
    f"""WITH {views.EVENTS} SELECT count(DISTINCT file) AS files, count(*) AS lines,
        count(*) FILTER (WHERE {_IS_ERROR}) AS matches, CAST(0 AS BIGINT) AS unknown,
        min(CASE WHEN {_IS_ERROR} THEN sec END) AS first_event,
        max(CASE WHEN {_IS_ERROR} THEN sec END) AS last_event FROM e"""
)
def run_statistics(spark, sf_dir):
    return output.run_stats(parse_headers(views.lines(spark, sf_dir)), _ERRORS.selects())


@query(
    f"""{_CONTEXT} SELECT file || CASE kind WHEN 'match' THEN ':' ELSE '-' END || line_no
        || CASE kind WHEN 'match' THEN ':' ELSE '-' END || raw AS text FROM x"""
)
def print_lines_with_prefix(spark, sf_dir):
    shown = output.format_lines(_context(spark, sf_dir), with_filename=True, line_number=True)
    return shown.select(F.col("text"))


_NOISY = "CASE WHEN event_id % 10 = 9 THEN 'noise ' || v ELSE " + views.stamped(views.SYSLOG_TEXT) + " END"
_FOUND = "event_type = 'error' AND event_id % 10 <> 9"


@query(
    f"""WITH {views.EVENTS} SELECT count(DISTINCT file) AS files, count(*) AS lines,
        count(*) FILTER (WHERE {_FOUND}) AS matches, count(*) FILTER (WHERE event_id % 10 = 9) AS unknown,
        min(sec) FILTER (WHERE {_FOUND}) AS first_event, max(sec) FILTER (WHERE {_FOUND}) AS last_event FROM e"""
)
def search_statistics(spark, sf_dir):
    """Of a whole run: lines read, unknown ones too, and what was selected."""
    run = LogSearch(apps=apps.ALL, patterns=Patterns.of(r"error\["))
    return run.stats(views.lines(spark, sf_dir, raw=_NOISY))


@query(
    f"""WITH {views.EVENTS} SELECT file, least(count(*) FILTER (WHERE event_type = 'error'), 3) AS matches
    FROM e GROUP BY file"""
)
def max_count_counts(spark, sf_dir):
    """Counts of a run that stops after three lines of each file."""
    run = LogSearch(apps=apps.ALL, patterns=Patterns.of(r"error\["), max_count=3)
    return run.counts(views.numbered(spark, sf_dir))
