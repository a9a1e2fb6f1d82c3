"""Totals, top lists, tables and whole reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import apps, daemons, views
from catalog.daemons import ADDRESS, CLIENT, MAIL, USER
from catalog.registry import query
from logweave import Item, LogSearch, Pick, Section, Where
from logweave.functions.units import scale_unit
from logweave.operators import reports
from logweave.operators.joins import checkpoint_dir
from logweave.operators.output import run_stats
from logweave.packs import asa, barracuda, crond, dovecot, ntpd, postfix, sshd
from logweave.sources.sinks import write_csv_tables


def _results(spark, sf_dir):
    return LogSearch(apps=apps.ALL).results(views.lines(spark, sf_dir))


@query(
    f"""WITH {views.EVENTS} SELECT * FROM (
        SELECT 0 AS pick_no, count(*) FILTER (WHERE event_type = 'purchase') AS total, 'orders' AS description FROM e
        UNION ALL SELECT 1, count(*) FILTER (WHERE event_type = 'error' AND k % 10 = 7), 'errors in 7' FROM e
        UNION ALL SELECT 2, count(*) FILTER (WHERE event_type = 'error' AND h <> 1), 'errors elsewhere' FROM e)
    WHERE total <> 0"""
)
def report_totals(spark, sf_dir):
    """Events meeting a condition; a total of zero is left out."""
    return reports.totals(
        _results(spark, sf_dir),
        [
            Pick("bought", ('"orders"',)),
            Pick("failed", ('"errors in 7"',), Where("code", "7$")),
            Pick("failed", ('"errors elsewhere"',), Where("host", "^host1$", negate=True)),
            Pick("failed", ('"none"',), Where("code", "x")),
        ],
    )


@query(
    f"""WITH {views.EVENTS} SELECT 0 AS pick_no, CAST(sum(v) AS BIGINT) AS total, 'value' AS description
    FROM e WHERE event_type = 'purchase'"""
)
def report_value_total(spark, sf_dir):
    return reports.totals(_results(spark, sf_dir), [Pick("bought", ('"value"',), value="amount")])


def _top_sql(where: str, value: str, amount: str, size: int, number: int = 0) -> str:
    return f"""SELECT 0 AS list_no, {number} AS pick_no, CAST(rank AS INTEGER) AS rank, total, value FROM (
        SELECT *, dense_rank() OVER (ORDER BY total DESC) AS rank FROM (
            SELECT {value} AS value, CAST({amount} AS BIGINT) AS total FROM e WHERE {where} GROUP BY 1))
        WHERE rank <= {size}"""


@query(f"WITH {views.EVENTS} " + _top_sql("event_type = 'error'", "CAST(user_id AS VARCHAR)", "count(*)", 5))
def report_top_events(spark, sf_dir):
    """Users with most errors; equal counts share a rank."""
    return reports.top_values(_results(spark, sf_dir), [(0, 5, Pick("failed", ("thread",)))])


@query(f"WITH {views.EVENTS} " + _top_sql("event_type = 'purchase' AND k < 50", "CAST(user_id AS VARCHAR)", "sum(v)", 7))
def report_top_sums(spark, sf_dir):
    pick = Pick("bought", ("thread",), Where("code", "^[1-4]?[0-9]$"), value="amount", add=True)
    return reports.top_values(_results(spark, sf_dir), [(0, 7, pick)])


@query(
    f"""WITH {views.EVENTS} SELECT 0 AS list_no, 0 AS pick_no, CAST(row_number() OVER (ORDER BY total DESC, value DESC) AS INTEGER) AS rank,
        total, value FROM (SELECT DISTINCT 'host' || h AS host, CAST(k AS VARCHAR) AS value, v AS total, user_id
                           FROM e WHERE event_type = 'purchase')
    QUALIFY rank <= 10"""
)
def report_top_maximum(spark, sf_dir):
    """Largest single values; a group may appear again."""
    return reports.top_values(_results(spark, sf_dir), [(0, 10, Pick("bought", ("code",), value="amount"))])


@query(
    f"WITH {views.EVENTS} "
    + _top_sql("event_type = 'error'", "'host' || h", "count(*)", 3)
    + " UNION ALL "
    + _top_sql("event_type = 'click'", "'host' || h", "count(*)", 3, 1)
)
def report_top_of_rules(spark, sf_dir):
    """One list over several rules: each gives its own top entries."""
    picks = [(0, 3, Pick("failed", ("host",))), (0, 3, Pick("clicked", ("host",)))]
    return reports.top_values(_results(spark, sf_dir), picks)


_TABLE = Item(
    "login",
    "Codes",
    "table",
    (
        Pick("failed", ("host", '"error"', "code", "thread"), Where("code", "^[1-3][0-9]$")),
        Pick("bought", ("host", '"order"', "code", "thread"), Where("code", "^9")),
    ),
    ("Host", "Service", "Code::user"),
)
_ENTRIES = f"""WITH {views.EVENTS},
r AS (SELECT CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS pick_no, 'host' || h AS host,
             CASE event_type WHEN 'error' THEN 'error' ELSE 'order' END AS service,
             CAST(k AS VARCHAR) AS code, CAST(user_id AS VARCHAR) AS user, count(*) AS n
      FROM e WHERE (event_type = 'error' AND k BETWEEN 10 AND 39) OR (event_type = 'purchase' AND (k = 9 OR k >= 90))
      GROUP BY ALL)"""


@query(f"{_ENTRIES} SELECT pick_no, host, service, code || '::' || user AS entry, n AS events FROM r")
def report_table_entries(spark, sf_dir):
    entries = reports.table_entries(_results(spark, sf_dir), [(0, _TABLE)])
    return entries.select(
        "pick_no", F.col("cols")[0].alias("host"), F.col("cols")[1].alias("service"),
        F.array_join("entry", "::").alias("entry"), "events",
    )


def _cells(keys: str, source: str, entry: str, order: str, limit: int) -> str:
    return f"""SELECT {keys}, string_agg({entry} || '(' || n || ')', ', ' ORDER BY n DESC, {order})
        || CASE WHEN max(entries) > count(*) THEN ' [' || (max(entries) - count(*)) || ' more skipped]' ELSE '' END AS cell
    FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) AS entries,
                 row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, {order}) AS rn FROM {source})
    WHERE n > 1 OR rn <= {limit} GROUP BY {keys}"""


@query(f"{_ENTRIES} " + _cells("pick_no, host, service", "r", "code || '::' || user", "code, user", 10))
def report_counted_cells(spark, sf_dir):
    """Cells like ``12::7(3), 13::8(1) [4 more skipped]``."""
    entries = reports.table_entries(_results(spark, sf_dir), [(0, _TABLE)])
    keys = ["pick_no", "cols"]
    cells = reports.whole_cells(reports.counted_cells(entries, keys, limit=10), keys)
    return cells.select(
        "pick_no", F.col("cols")[0].alias("host"), F.col("cols")[1].alias("service"), "cell"
    )


def _scaled(steps: int) -> str:
    value, label = "t", "'B'"
    for i in range(steps):
        moved = f"({value}) >= 10000"
        label = f"CASE WHEN {moved} THEN '{'kMGT'[i]}B' ELSE {label} END"
        value = f"CASE WHEN {moved} THEN CAST(round_even(({value}) / 1000.0, 0) AS BIGINT) ELSE ({value}) END"
    return f"{value} AS value, {label} AS unit"


@query(
    f"""WITH s AS (SELECT o_custkey, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) * 37 AS t
        FROM orders GROUP BY 1) SELECT o_custkey, {_scaled(4)} FROM s"""
)
def scale_units(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    total = F.sum(F.floor("o_totalprice").cast("bigint")) * 37
    value, unit = scale_unit(F.col("t"), "B", "T")
    return orders.groupBy("o_custkey").agg(total.alias("t")).select(
        "o_custkey", value.cast("bigint").alias("value"), unit.alias("unit")
    )


# -- whole reports -----------------------------------------------------------


def _report(spark, sf_dir, app, message, sections=None, names=()):
    run = LogSearch(apps=(app,), app_names=names)
    rows = run.report(daemons.read(spark, sf_dir, message), sections)
    return rows.select(
        "subreport", "title", F.col("row_no"), F.array_join("cols", " | ").alias("row")
    )


def _login_table(title: str, services: dict[str, str], root: bool) -> str:
    names = ", ".join(f"'{t}'" for t in services)
    service = "CASE event_type " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in services.items()) + " END"
    if root:
        key, entry, order, where = "'host' || h", "e1", "e1", f"{USER} = 'root'"
        first, second = ADDRESS, "''"
    else:
        key, entry, order, where = USER, "e1 || '::' || e2", "e1, e2", f"{USER} <> 'root'"
        first, second = "'host' || h", ADDRESS
    source = f"""(SELECT {key} AS c1, {service} AS c2, {first} AS e1, {second} AS e2, count(*) AS n
                  FROM e WHERE event_type IN ({names}) AND {where} GROUP BY ALL)"""
    return f"""SELECT 'Logins' AS subreport, '{title}' AS title,
        row_number() OVER (ORDER BY c1, c2, cell) AS row_no, c1 || ' | ' || c2 || ' | ' || cell AS row
    FROM ({_cells('c1, c2', source, entry, order, 5)})"""


_ACCEPTED = {"signup": "publickey", "purchase": "password"}


@query(
    f"WITH {views.EVENTS} "
    + " UNION ALL ".join(
        [
            _login_table("Logins of users", _ACCEPTED, False),
            _login_table("Logins of root", _ACCEPTED, True),
            _login_table("Failed logins of users", {"error": "password"}, False),
            _login_table("Failed logins of root", {"error": "password"}, True),
        ]
    )
)
def report_sshd(spark, sf_dir):
    return _report(spark, sf_dir, sshd.APP, daemons.SSHD)


@query(
    f"WITH {views.EVENTS} "
    + _login_table("Logins of users", {"signup": "imap", "purchase": "pop3"}, False)
    + " UNION ALL "
    + _login_table("Failed logins of users", {"error": "imap"}, False)
)
def report_dovecot(spark, sf_dir):
    return _report(spark, sf_dir, dovecot.APP, daemons.DOVECOT)


def _total_item(title: str, rows: list[tuple[str, str]]) -> str:
    """Rows ``(total SQL, description)`` in order, zero totals left out."""
    parts = " UNION ALL ".join(
        f"SELECT {i} AS o, {total} AS total, '{text}' AS text FROM e" for i, (total, text) in enumerate(rows)
    )
    return f"""SELECT 'Mail report' AS subreport, '{title}' AS title, row_number() OVER (ORDER BY o) AS row_no,
        CAST(total AS VARCHAR) || ' | ' || text AS row FROM ({parts}) WHERE CAST(total AS VARCHAR) <> '0'"""


def _top_item(title: str, where: str, value: str, size: int, amount: str = "count(*)", text: str = "t",
              section: str = "Mail report") -> str:
    return f"""SELECT '{section}' AS subreport, '{title}' AS title,
        row_number() OVER (ORDER BY t DESC, {text}, value) AS row_no, {text} || ' | ' || value AS row
    FROM (SELECT *, dense_rank() OVER (ORDER BY t DESC) AS rank FROM (
        SELECT {value} AS value, CAST({amount} AS BIGINT) AS t FROM e WHERE {where} GROUP BY 1))
    WHERE rank <= {size}"""


def _bytes(total: str) -> str:
    value, label = f"({total})", "'B'"
    for i in range(4):
        moved = f"({value}) >= 10000"
        label = f"CASE WHEN {moved} THEN '{'kMGT'[i]}B' ELSE {label} END"
        value = f"CASE WHEN {moved} THEN CAST(round_even(({value}) / 1000.0, 0) AS BIGINT) ELSE ({value}) END"
    return f"(({value}) || ' ' || {label})"


_SIZES = f"""SELECT 'Mail report' AS subreport, 'Largest mails' AS title,
    row_number() OVER (ORDER BY t DESC, text, value) AS row_no, text || ' | ' || value AS row
    FROM (SELECT *, {_bytes('t')} AS text FROM (
        SELECT {MAIL} AS value, v * 100 AS t FROM e WHERE event_type = 'purchase' ORDER BY t DESC, value DESC LIMIT 10))"""


@query(
    f"WITH {views.EVENTS} "
    + " UNION ALL ".join(
        [
            _total_item(
                "Mail in numbers",
                [
                    ("CAST(count(*) FILTER (WHERE event_type = 'purchase') AS VARCHAR)", "Messages queued"),
                    ("CAST(count(*) FILTER (WHERE event_type = 'view') AS VARCHAR)", "Deliveries"),
                    ("CAST(count(*) FILTER (WHERE event_type = 'error') AS VARCHAR)", "Deliveries put off"),
                    (
                        _bytes("CAST(sum(CASE WHEN event_type = 'purchase' THEN v * 100 ELSE 0 END) AS BIGINT)"),
                        "Size of all messages",
                    ),
                ],
            ),
            _top_item("Busiest servers", "event_type = 'purchase'", "'host' || h", 5),
            _top_item("Clients with most mails", "event_type = 'signup'", CLIENT, 5),
            _top_item("Senders with most mails", "event_type = 'purchase'", MAIL, 10),
            _top_item("Recipients with most mails", "event_type = 'view'", MAIL, 10),
            _SIZES,
            _top_item("Senders with most bytes", "event_type = 'purchase'", MAIL, 10, "sum(v * 100)", _bytes("t")),
        ]
    )
)
def report_postfix(spark, sf_dir):
    return _report(spark, sf_dir, postfix.APP, daemons.POSTFIX)


_SCAN = "event_type IN ('signup', 'purchase')"
_ACTION = "CASE event_type WHEN 'signup' THEN k % 6 WHEN 'purchase' THEN 2 END"
_BSVF_CLIENT = f"{CLIENT} || '[10.0.0.' || k || ']'"


@query(
    f"WITH {views.EVENTS} "
    + " UNION ALL ".join(
        [
            _total_item(
                "Spam firewall in numbers",
                [(f"count(*) FILTER (WHERE {_SCAN})", "Scanned")]
                + [
                    (f"count(*) FILTER (WHERE {_SCAN} AND {_ACTION} = {code})", text)
                    for code, text in (
                        (0, "Allowed"),
                        (1, "Aborted"),
                        (2, "Blocked"),
                        (3, "Quarantined"),
                        (4, "Tagged"),
                        (5, "Deferred"),
                    )
                ]
                + [("count(*) FILTER (WHERE event_type = 'view' AND k % 5 = 3)", "Sending put off")],
            ),
            _top_item("Spam firewall: clients", _SCAN, _BSVF_CLIENT, 5),
            _top_item("Spam firewall: senders", _SCAN, MAIL, 10),
            _top_item("Spam firewall: recipients", _SCAN, "'to@example.com'", 10),
        ]
    )
)
def report_barracuda(spark, sf_dir):
    return _report(spark, sf_dir, barracuda.APP, daemons.BARRACUDA)


_TORN = "event_type = 'error'"


@query(
    f"WITH {views.EVENTS} "
    + _total_item(
        "Connections",
        [
            (f"CAST(count(*) FILTER (WHERE {_TORN}) AS VARCHAR)", "Torn down"),
            (_bytes(f"CAST(sum(CASE WHEN {_TORN} THEN v ELSE 0 END) AS BIGINT)"), "Bytes of those torn down"),
            ("CAST(count(*) FILTER (WHERE event_type = 'signup') AS VARCHAR)", "Denied"),
        ],
    ).replace("'Mail report'", "'Network'")
    + " UNION ALL "
    + _top_item("Peers with most bytes", _TORN, ADDRESS, 5, "sum(v)", _bytes("t"), section="Network")
)
def report_asa(spark, sf_dir):
    return _report(spark, sf_dir, asa.APP, daemons.ASA)


_JOBS = f"""(SELECT 'host' || h AS c1, {USER} AS c2, CASE event_type WHEN 'signup' THEN '/usr/bin/job ' || (k % 3)
    ELSE '/usr/bin/sync' END AS e1, count(*) AS n FROM e WHERE event_type IN ('signup', 'purchase') GROUP BY ALL)"""


@query(
    f"""WITH {views.EVENTS} SELECT 'System commands' AS subreport, 'Cron Commands' AS title,
        row_number() OVER (ORDER BY c1, c2) AS row_no, c1 || ' | ' || c2 || ' | ' || cell AS row
    FROM ({_cells('c1, c2', _JOBS, 'e1', 'e1', 5)})"""
)
def report_crond(spark, sf_dir):
    return _report(spark, sf_dir, crond.APP, daemons.CRON)


@query(
    f"WITH {views.EVENTS} "
    + _total_item(
        "Time server",
        [("count(*) FILTER (WHERE event_type IN ('signup', 'purchase'))", "Times synchronized")],
    ).replace("'Mail report'", "'Database lookups'")
    + " UNION ALL "
    + _top_item(
        "Peers most synchronized to", "event_type = 'signup'", "'10.0.0.' || (k % 8)", 5,
        section="Database lookups",
    )
)
def report_ntpd(spark, sf_dir):
    """A pack that is not enabled runs when it is named; its condition applies to the top list."""
    return _report(spark, sf_dir, ntpd.APP, daemons.NTPD, names=("ntpd",))


@query(
    f"""WITH {views.EVENTS} SELECT c1 AS "Hostname", c2 AS "User", cell AS "Commands"
    FROM ({_cells('c1, c2', _JOBS, 'e1', 'e1', 10)})"""
)
def write_csv_report(spark, sf_dir):
    """A report table written as CSV and read back; cells show ten entries."""
    run = LogSearch(apps=(crond.APP,))
    table = run.report(daemons.read(spark, sf_dir, daemons.CRON), limit=10)
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    (written,) = write_csv_tables(table, {1: crond.APP.items[0]}, path)
    return spark.read.csv(written, sep="|", header=True)


_MERGED = [Section("login", "Logins")]


@query(
    f"WITH {views.EVENTS}, u AS ("
    + " UNION ALL ".join(
        [
            _login_table("Logins of users", _ACCEPTED, False),
            _login_table("Logins of users", {"view": "imap", "click": "pop3"}, False),
        ]
    )
    + ") SELECT title, row_number() OVER (ORDER BY row) AS row_no, row FROM u"
)
def merge_tables(spark, sf_dir):
    """Tables of two apps with the same title and headers become one."""
    login = "'user=<' || " + USER + " || '>, PID=' || event_id || ', TLS, rip=' || " + ADDRESS
    both = (
        "CASE WHEN event_type IN ('signup', 'purchase') THEN " + daemons.SSHD
        + " WHEN event_type = 'view' THEN 'dovecot: imap-login: Login: ' || " + login
        + " WHEN event_type = 'click' THEN 'dovecot: pop3-login: Login: ' || " + login
        + " ELSE 'kernel: up' END"
    )
    run = LogSearch(apps=(sshd.APP, dovecot.APP))
    rows = run.report(daemons.read(spark, sf_dir, both), _MERGED).filter("title = 'Logins of users'")
    return rows.select("title", "row_no", F.array_join("cols", " | ").alias("row"))


@query(
    f"""WITH {views.EVENTS},
    m AS (SELECT *, event_type IN ('error', 'purchase') AS hit FROM e)
    SELECT 'System events' AS title, '''k=1''' AS patterns, '(user=''u1'' AND client=''10'') OR (uid=''5'')' AS filters,
        'host*' AS hosts,
        (SELECT string_agg(app || '(' || n || ')', ', ' ORDER BY app || '(' || n || ')') FROM (
            SELECT CASE event_type WHEN 'error' THEN 'trouble' ELSE 'shop' END AS app, count(*) AS n FROM m
            WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1)) AS apps,
        count(DISTINCT file) AS files, count(*) AS lines, count(*) FILTER (WHERE k = 1 OR k BETWEEN 10 AND 19) AS matches,
        CAST(0 AS BIGINT) AS unknown, min(sec) FILTER (WHERE k = 1 OR k BETWEEN 10 AND 19) AS first_event,
        max(sec) FILTER (WHERE k = 1 OR k BETWEEN 10 AND 19) AS last_event FROM m"""
)
def report_header(spark, sf_dir):
    run = LogSearch(apps=(apps.SHOP, apps.TROUBLE))
    lines = views.lines(spark, sf_dir)
    stats = run_stats(run.parse(lines), F.col("raw").contains(" k=1"))
    return reports.report_header(
        spark,
        stats,
        run.app_counters(lines),
        "System events",
        ["k=1"],
        [{"user": "u1", "client": "10"}, {"uid": "5"}],
        ["host*"],
    )
