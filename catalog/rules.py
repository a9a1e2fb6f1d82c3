"""Routing, rules, modes, filters, counters and the shipped packs (F13, F14, R1-R13, RP1-RP7)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from catalog import apps, daemons, views
from catalog.daemons import ADDRESS, CLIENT, MAIL, QUEUE, USER
from catalog.registry import query
from logweave import App, HeaderFormat, LogSearch, Rule, parse_filter
from logweave.operators import rules
from logweave.operators.headers import RFC3164, parse_headers
from logweave.packs import asa, barracuda, crond, dovecot, ntpd, postfix, sshd

_APP = """CASE event_type WHEN 'error' THEN 'trouble' WHEN 'purchase' THEN 'shop' WHEN 'signup' THEN 'shop'
          ELSE 'web' END"""
_MATCHED = "(event_type <> 'view' OR k < 50)"


def _events(spark, sf_dir, **options):
    return parse_headers(views.lines(spark, sf_dir, **options))


@query(
    f"""WITH {views.EVENTS} SELECT event_id, {_APP} AS app,
        CASE WHEN {_MATCHED} THEN CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'bought'
             WHEN 'signup' THEN 'registered' WHEN 'view' THEN 'seen' ELSE 'clicked' END END AS rule,
        CASE WHEN {_MATCHED} THEN CAST(user_id AS VARCHAR) END AS thread,
        CASE WHEN {_MATCHED} THEN CAST(k AS VARCHAR) END AS code,
        CASE WHEN {_MATCHED} THEN CAST(v AS VARCHAR) END AS amount FROM e"""
)
def extract_fields(spark, sf_dir):
    """Exact tags, and fields by the first matching rule."""
    parsed = rules.apply_rules(_events(spark, sf_dir), apps.ALL)
    return parsed.select(
        "event_id", "app", "rule", "thread",
        F.col("fields")["code"].alias("code"), F.col("fields")["amount"].alias("amount"),
    )


@query(
    f"""WITH {views.EVENTS} SELECT CASE WHEN event_type IN ('signup', 'click') THEN 'starts'
        WHEN event_type = 'purchase' THEN 'exact' END AS app, count(*) AS lines FROM e GROUP BY 1"""
)
def route_by_tag_prefix(spark, sf_dir):
    """A tag that no app owns goes to the app with a tag it starts with."""
    any_line = (Rule("line", "k="),)
    packs = [
        App("starts", "", ("sign", "cli", "purch"), any_line),
        App("exact", "", ("purchase",), any_line),
    ]
    routed = rules.route(_events(spark, sf_dir), packs)
    return routed.groupBy("app").agg(F.count(F.lit(1)).alias("lines"))


@query(
    f"""WITH {views.EVENTS} SELECT CASE WHEN k < 30 THEN 'low' WHEN k >= 60 THEN 'high' ELSE 'low' END AS app,
        CASE WHEN k < 30 THEN 'small' WHEN k >= 60 THEN 'large' END AS rule, count(*) AS lines
    FROM e WHERE event_type = 'view' GROUP BY 1, 2"""
)
def route_shared_tag(spark, sf_dir):
    """Two apps own a tag: the one with a matching rule, else the first."""
    packs = [
        App("high", "", ("view",), (Rule("large", "k=[6-9][0-9] "),), priority=2),
        App("low", "", ("view",), (Rule("small", "k=[12]?[0-9] "),), priority=1),
    ]
    parsed = rules.apply_rules(_events(spark, sf_dir), packs).filter("app is not null")
    return parsed.groupBy("app", "rule").agg(F.count(F.lit(1)).alias("lines"))


_NO_TAG = (
    "date_format(ts, 'yyyy-MM-dd') || 'T' || date_format(ts, 'HH:mm:ss') || 'Z host' || h || ' '"
    " || CASE WHEN h < 3 THEN '-' ELSE CAST(user_id AS STRING) END || ' - - '"
    " || event_type || '[' || user_id || ']: k=' || k || ' v=' || v"
)


@query(
    f"""WITH {views.EVENTS} SELECT CASE WHEN {_MATCHED} THEN {_APP} END AS app, count(*) AS lines FROM e GROUP BY 1"""
)
def route_without_tag(spark, sf_dir):
    """Lines with no tag, or a number for one, go to the first app with a matching rule."""
    parsed = rules.apply_rules(_events(spark, sf_dir, raw=_NO_TAG), apps.ALL)
    return parsed.groupBy("app").agg(F.count(F.lit(1)).alias("lines"))


@query(
    f"""WITH {views.EVENTS} SELECT event_type AS apptag, count(*) AS lines FROM e
    WHERE event_type IN ('view', 'click', 'error') GROUP BY 1"""
)
def extra_tags(spark, sf_dir):
    return rules.extra_tags(_events(spark, sf_dir), [apps.SHOP])


@query(f"WITH {views.EVENTS} SELECT event_id, {_APP} AS app FROM e WHERE {_MATCHED} AND event_type <> 'error'")
def ruled_lines(spark, sf_dir):
    run = LogSearch(apps=apps.ALL, app_names=("shop", "web"))
    return run.select(views.lines(spark, sf_dir)).select("event_id", "app")


@query(f"WITH {views.EVENTS} SELECT event_id, 'web' AS app FROM e WHERE NOT {_MATCHED}")
def unparsed_lines(spark, sf_dir):
    run = LogSearch(apps=apps.ALL, mode="unparsed")
    return run.select(views.lines(spark, sf_dir)).select("event_id", "app")


@query(f"WITH {views.EVENTS} SELECT event_id, {_APP} AS app FROM e WHERE event_type <> 'error'")
def unruled_lines(spark, sf_dir):
    run = LogSearch(apps=apps.ALL, app_names=("shop", "web"), mode="unruled")
    return run.select(views.lines(spark, sf_dir)).select("event_id", "app")


@query(
    f"""WITH {views.EVENTS} SELECT {_APP} AS app, count(*) FILTER (WHERE {_MATCHED}) AS matches,
        count(*) FILTER (WHERE NOT {_MATCHED}) AS unparsed FROM e GROUP BY 1"""
)
def app_counters(spark, sf_dir):
    return LogSearch(apps=apps.ALL).app_counters(views.lines(spark, sf_dir))


_NOTICES = (
    "CASE WHEN event_id % 5 = 4 THEN date_format(ts, 'MMM') || ' ' || lpad(CAST(day(ts) AS STRING), 2, ' ')"
    " || ' ' || date_format(ts, 'HH:mm:ss') || ' last message repeated ' || (k % 9 + 1) || ' times'"
    " WHEN event_id % 11 IN (7, 8) THEN 'noise'"
    f" ELSE {views.stamped(views.SYSLOG_TEXT)} END"
)
_WEIGHTS = f"""WITH {views.NUMBERED},
p AS (SELECT *, event_id % 5 = 4 AS notice FROM l WHERE event_id % 5 = 4 OR event_id % 11 NOT IN (7, 8)),
w AS (SELECT *, 1 + CASE WHEN lead(notice) OVER o THEN lead(k % 9 + 1) OVER o ELSE 0 END AS weight
      FROM p WINDOW o AS (PARTITION BY file ORDER BY line_no))"""


@query(f"{_WEIGHTS} SELECT file, line_no, CAST(weight AS BIGINT) AS weight FROM w WHERE NOT notice")
def fold_repeat_notices(spark, sf_dir):
    parsed = parse_headers(views.numbered(spark, sf_dir, raw=_NOTICES))
    return rules.fold_repeats(parsed).select("file", "line_no", "weight")


@query(
    f"""{_WEIGHTS} SELECT file, CAST(sum(CASE WHEN notice OR event_type <> 'error' THEN 0 ELSE weight END) AS BIGINT)
        AS matches FROM w GROUP BY file"""
)
def count_with_repeats(spark, sf_dir):
    run = LogSearch(apps=apps.ALL, app_names=("trouble",), repeats=True)
    return run.counts(views.numbered(spark, sf_dir, raw=_NOTICES))


@query(
    f"""WITH {views.EVENTS} SELECT {_APP} AS app, CASE event_type WHEN 'error' THEN 'failed'
        WHEN 'purchase' THEN 'bought' WHEN 'signup' THEN 'registered' WHEN 'view' THEN 'seen' ELSE 'clicked' END AS rule,
        'host' || h AS host, '{{"amount":"' || v || '","code":"' || k || '","thread":"' || user_id || '"}}' AS fields,
        count(*) AS events FROM e WHERE {_MATCHED} GROUP BY ALL"""
)
def rule_results(spark, sf_dir):
    results = LogSearch(apps=apps.ALL).results(views.lines(spark, sf_dir))
    return results.withColumn("fields", rules.fields_json())


@query(f"WITH {views.EVENTS} SELECT event_id, 'shop' AS app, 'any' AS rule FROM e")
def format_bound_to_app(spark, sf_dir):
    """A header format can imply the application, whatever the tag says."""
    bound = HeaderFormat("shop-lines", RFC3164.pattern, app="shop")
    parsed = parse_headers(views.lines(spark, sf_dir), (bound,))
    packs = [replace(apps.SHOP, rules=(Rule("any", "k="),)), apps.WEB]
    return rules.apply_rules(parsed, packs).select("event_id", "app", "rule")


@query(
    f"""WITH {views.EVENTS} SELECT event_id, event_type FROM e
    WHERE (event_type IN ('signup', 'purchase', 'error') AND {USER} = 'u7' AND user_id % 5 = 2)
       OR (event_type = 'click' AND k BETWEEN 10 AND 19)"""
)
def filter_fields(spark, sf_dir):
    """Groups of field filters: all of a group, any of the groups."""
    groups = (parse_filter(r"user=u7,client=10\.0\.2\.\d+"), parse_filter("uid=1[0-9]"))
    run = LogSearch(apps=(sshd.APP,), filters=groups)
    found = run.select(views.lines(spark, sf_dir, daemons.SSHD, keep=("event_id", "event_type")))
    return found.select("event_id", "event_type")


_OPTIONAL = (
    "event_type || '[' || user_id || ']: k=' || k || CASE WHEN h < 3 THEN ' user=u' || h ELSE '' END"
)


@query(f"WITH {views.EVENTS} SELECT event_id, 'u' || h AS user FROM e WHERE h < 3")
def filter_needs_field(spark, sf_dir):
    """A rule matches, but the filtered field took no part: the line is not selected."""
    packs = (App("all", "", ("view", "click", "error", "signup", "purchase"), (Rule("line", r"k=\d+(?: user={user})?$"),)),)
    run = LogSearch(apps=packs, filters=({"user": "u[0-9]"},))
    found = run.select(views.lines(spark, sf_dir, _OPTIONAL))
    return found.select("event_id", F.col("fields")["user"].alias("user"))


# -- shipped packs -----------------------------------------------------------


def _parsed(spark, sf_dir, message, app):
    return rules.apply_rules(parse_headers(daemons.read(spark, sf_dir, message)), [app])


def _fields(parsed, *names):
    return parsed.select("event_id", "rule", *[F.col("fields")[n].alias(n) for n in names])


@query(
    f"""WITH {views.EVENTS} SELECT event_id,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'closed' WHEN 'click' THEN 'session_opened'
             ELSE 'accepted' END AS rule,
        CASE event_type WHEN 'signup' THEN 'publickey' WHEN 'purchase' THEN 'password' WHEN 'error' THEN 'password' END AS method,
        CAST(event_id AS VARCHAR) AS thread, CASE WHEN event_type <> 'view' THEN {USER} END AS user,
        CASE WHEN event_type <> 'click' THEN {ADDRESS} END AS client,
        CASE WHEN event_type = 'click' THEN CAST(k AS VARCHAR) END AS uid FROM e"""
)
def pack_sshd(spark, sf_dir):
    return _fields(_parsed(spark, sf_dir, daemons.SSHD, sshd.APP), "method", "thread", "user", "client", "uid")


@query(
    f"""WITH {views.EVENTS} SELECT event_id,
        CASE event_type WHEN 'purchase' THEN 'queued' WHEN 'view' THEN 'sent' WHEN 'error' THEN 'deferred'
             WHEN 'signup' THEN 'accepted' ELSE 'connect' END AS rule,
        CASE WHEN event_type <> 'click' THEN {QUEUE} END AS thread,
        CASE WHEN event_type = 'purchase' THEN {MAIL} END AS "from",
        CASE WHEN event_type IN ('view', 'error') THEN {MAIL} END AS rcpt,
        CASE WHEN event_type IN ('signup', 'click') THEN {CLIENT} END AS client,
        CASE WHEN event_type = 'purchase' THEN CAST(v * 100 AS VARCHAR) END AS size FROM e"""
)
def pack_postfix(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, daemons.POSTFIX, postfix.APP)
    return _fields(parsed, "thread", "from", "rcpt", "client", "size")


@query(
    f"""WITH {views.EVENTS} SELECT event_id,
        CASE event_type WHEN 'signup' THEN 'login' WHEN 'purchase' THEN 'login'
             WHEN 'error' THEN 'login_failed' WHEN 'view' THEN 'saved' ELSE 'closed' END AS rule,
        CASE event_type WHEN 'purchase' THEN 'pop3' WHEN 'view' THEN 'deliver' ELSE 'imap' END AS protocol,
        CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN CAST(event_id AS VARCHAR) END AS thread,
        {USER} AS user, CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN {ADDRESS} END AS client,
        CASE event_type WHEN 'error' THEN 'auth failed, 1 attempts' WHEN 'click' THEN ' bytes=' || v END AS reason,
        CASE WHEN event_type = 'view' THEN 'INBOX' END AS folder FROM e"""
)
def pack_dovecot(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, daemons.DOVECOT, dovecot.APP)
    return _fields(parsed, "protocol", "thread", "user", "client", "reason", "folder")


@query(
    f"""WITH {views.EVENTS} SELECT event_id,
        CASE event_type WHEN 'signup' THEN 'denied' WHEN 'purchase' THEN 'command'
             WHEN 'view' THEN 'login_permitted' WHEN 'error' THEN 'torn_down' END AS rule,
        CASE WHEN event_type IN ('signup', 'error') THEN {ADDRESS} END AS client1,
        CASE event_type WHEN 'signup' THEN 'udp' WHEN 'error' THEN 'TCP' END AS protocol,
        CASE WHEN event_type IN ('purchase', 'view') THEN {USER} END AS user,
        CASE WHEN event_type = 'purchase' THEN 'show run ' || k END AS command,
        CASE WHEN event_type = 'error' THEN CAST(v AS VARCHAR) END AS size FROM e"""
)
def pack_asa(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, daemons.ASA, asa.APP)
    return _fields(parsed, "client1", "protocol", "user", "command", "size")


@query(
    f"""WITH {views.EVENTS} SELECT event_id,
        CASE event_type WHEN 'signup' THEN 'scanned' WHEN 'purchase' THEN 'scanned' WHEN 'view' THEN 'sent'
             WHEN 'error' THEN 'received' END AS rule,
        CASE WHEN event_type IN ('signup', 'view', 'error') THEN CAST(user_id AS VARCHAR) END AS pid,
        CASE WHEN event_type IN ('signup', 'purchase', 'error') THEN {CLIENT} || '[10.0.0.' || k || ']'
             WHEN event_type = 'view' THEN '127.0.0.1' END AS client,
        CASE WHEN event_type <> 'click' THEN 'id-' || event_id END AS thread,
        CASE event_type WHEN 'signup' THEN CAST(k % 6 AS VARCHAR) WHEN 'purchase' THEN '2'
             WHEN 'view' THEN CAST(k % 5 AS VARCHAR) WHEN 'error' THEN '1' END AS action FROM e"""
)
def pack_barracuda(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, daemons.BARRACUDA, barracuda.APP)
    return _fields(parsed, "pid", "client", "thread", "action")


@query(
    f"""WITH {views.EVENTS} SELECT event_id, CASE WHEN event_type <> 'click' THEN 'crond' END AS app,
        CASE WHEN event_type IN ('signup', 'purchase') THEN {USER} END AS user,
        CASE event_type WHEN 'signup' THEN '/usr/bin/job ' || (k % 3) WHEN 'purchase' THEN '/usr/bin/sync' END AS command
    FROM e"""
)
def pack_crond(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, daemons.CRON, crond.APP)
    return parsed.select(
        "event_id", "app", F.col("fields")["user"].alias("user"), F.col("fields")["command"].alias("command")
    )


@query(
    f"""WITH {views.EVENTS} SELECT event_id, CASE event_type WHEN 'signup' THEN '10.0.0.' || (k % 8)
        WHEN 'purchase' THEN 'ntp.example.com' END AS client FROM e"""
)
def pack_ntpd(spark, sf_dir):
    parsed = _parsed(spark, sf_dir, daemons.NTPD, ntpd.APP)
    return parsed.select("event_id", F.col("fields")["client"].alias("client"))
