"""Replacing field values (M1-M5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import daemons, views
from catalog.daemons import ADDRESS, USER
from catalog.registry import query
from logweave import LogSearch, Patterns
from logweave.operators import mapping
from logweave.operators.headers import parse_headers
from logweave.operators.rules import apply_rules
from logweave.packs import sshd

_APPS = [sshd.APP]


def _parsed(spark, sf_dir):
    return apply_rules(parse_headers(daemons.read(spark, sf_dir, daemons.SSHD)), _APPS)


_TOKENS = f"""WITH {views.EVENTS},
f AS (SELECT event_id, event_type, ts, h, k, 'host' || h AS host, CAST(event_id AS VARCHAR) AS thread,
             CASE WHEN event_type <> 'view' THEN {USER} END AS user,
             CASE WHEN event_type <> 'click' THEN {ADDRESS} END AS client,
             CASE WHEN event_type = 'click' THEN CAST(k AS VARCHAR) END AS uid, user_id FROM e),
a AS (SELECT DISTINCT 'host' AS base, host AS value FROM f UNION SELECT 'thread', thread FROM f
      UNION SELECT 'user', user FROM f UNION SELECT 'client', client FROM f UNION SELECT 'uid', uid FROM f),
n AS (SELECT base, value, row_number() OVER (PARTITION BY base ORDER BY value) AS no FROM a WHERE value IS NOT NULL),
t AS (SELECT base, value, upper(base) || '_'
             || CASE WHEN no < 1000 THEN lpad(CAST(no AS VARCHAR), 4, '0') ELSE CAST(no AS VARCHAR) END AS token
      FROM n),
m AS (SELECT f.*, th.token AS host_t, tt.token AS thread_t, tu.token AS user_t, tc.token AS client_t, ti.token AS uid_t
      FROM f LEFT JOIN t AS th ON th.base = 'host' AND th.value = f.host
             LEFT JOIN t AS tt ON tt.base = 'thread' AND tt.value = f.thread
             LEFT JOIN t AS tu ON tu.base = 'user' AND tu.value = f.user
             LEFT JOIN t AS tc ON tc.base = 'client' AND tc.value = f.client
             LEFT JOIN t AS ti ON ti.base = 'uid' AND ti.value = f.uid)"""


@query(f"{_TOKENS} SELECT base, value, token FROM t")
def mask_tokens(spark, sf_dir):
    return mapping.token_table(_parsed(spark, sf_dir), _APPS)


@query(
    f"""{_TOKENS} SELECT event_id, host_t AS host, thread_t AS thread, user_t AS user, client_t AS client,
        uid_t AS uid FROM m"""
)
def mask_fields(spark, sf_dir):
    parsed = _parsed(spark, sf_dir).select("event_id", "host", "fields", "matched")
    masked = mapping.mask_fields(parsed, _APPS)
    return masked.select(
        "event_id", "host", "thread", *[F.col("fields")[n].alias(n) for n in ("user", "client", "uid")]
    )


_PREFIX = "strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S ')"


@query(
    f"""{_TOKENS} SELECT event_id, {_PREFIX} || host_t || ' sshd[' || thread_t || ']: ' || CASE event_type
        WHEN 'signup' THEN 'Accepted publickey for ' || user_t || ' from ' || client_t || ' port 22 ssh2'
        WHEN 'purchase' THEN 'Accepted password for ' || user_t || ' from ' || client_t || ' port 22 ssh2'
        WHEN 'error' THEN 'Failed password for ' || user_t || ' from ' || client_t || ' port 22 ssh2'
        WHEN 'view' THEN 'Connection closed by ' || client_t
        ELSE 'pam_unix(sshd:session): session opened for user ' || user_t || ' by (uid=' || uid_t || ')' END AS raw
    FROM m"""
)
def mask_raw_lines(spark, sf_dir):
    """The masked values stand in the line where the old ones stood; lines are kept with the parts that takes."""
    parts = ("event_id", "raw", "format", "host", "message", "app", "rule", "fields", "matched")
    masked = mapping.mask_fields(_parsed(spark, sf_dir).select(*parts), _APPS)
    return mapping.rewrite_raw(masked, _APPS).select("event_id", "raw")


def _names(spark, sf_dir):
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    name = F.lower(F.replace("s_name", F.lit("#"), F.lit("-")))
    one = suppliers.select(F.expr("concat('10.0.', s_suppkey % 5, '.', s_suppkey div 5)").alias("address"), name.alias("name"))
    # every address has a second name
    return one.union(one.select("address", F.concat(F.lit("z-"), "name")))


def _users(spark, sf_dir):
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    # odd ids have no name
    return customers.select((F.col("c_custkey") * 2).alias("uid"), F.col("c_name").alias("name"))


_NAMED = f"""LEFT JOIN (SELECT '10.0.' || (s_suppkey % 5) || '.' || (s_suppkey // 5) AS address,
        lower(replace(s_name, '#', '-')) AS name FROM supplier) AS s ON s.address = {ADDRESS}"""
_USERS = "LEFT JOIN (SELECT c_custkey * 2 AS uid, c_name FROM customer) AS c ON c.uid = e.k"


@query(
    f"""WITH {views.EVENTS} SELECT event_id,
        CASE WHEN event_type <> 'click' THEN coalesce(s.name, {ADDRESS}) END AS client FROM e {_NAMED}"""
)
def name_addresses(spark, sf_dir):
    named = mapping.name_addresses(_parsed(spark, sf_dir), _APPS, _names(spark, sf_dir))
    return named.select("event_id", F.col("fields")["client"].alias("client"))


@query(
    f"""WITH {views.EVENTS} SELECT event_id, CASE WHEN event_type <> 'view' THEN {USER} END AS user,
        CASE WHEN event_type = 'click' THEN coalesce(c.c_name, 'uid=' || k) END AS uid FROM e {_USERS}"""
)
def name_user_ids(spark, sf_dir):
    named = mapping.name_uids(_parsed(spark, sf_dir), _APPS, _users(spark, sf_dir))
    return named.select("event_id", F.col("fields")["user"].alias("user"), F.col("fields")["uid"].alias("uid"))


@query(
    f"""WITH {views.EVENTS} SELECT event_id,
        CASE WHEN event_type <> 'click' THEN coalesce(s.name, {ADDRESS}) END AS client,
        CASE WHEN event_type = 'click' THEN coalesce(c.c_name, 'uid=' || k) END AS uid FROM e {_NAMED} {_USERS}"""
)
def name_addresses_and_users(spark, sf_dir):
    named = mapping.map_fields(
        _parsed(spark, sf_dir), _APPS, addresses=_names(spark, sf_dir), users=_users(spark, sf_dir)
    )
    return named.select("event_id", F.col("fields")["client"].alias("client"), F.col("fields")["uid"].alias("uid"))


_SHOWN = _TOKENS.replace(
    "f AS (SELECT event_id",
    """n0 AS (SELECT e.*, row_number() OVER (PARTITION BY file ORDER BY ts, event_id) AS line_no FROM e),
near AS (SELECT DISTINCT n0.event_id FROM n0 JOIN n0 AS hit ON n0.file = hit.file AND n0.line_no BETWEEN hit.line_no - 1 AND hit.line_no + 2
         WHERE hit.event_type = 'error' AND hit.k = 7),
f AS (SELECT event_id""",
    1,
).replace("user_id FROM e),", "user_id FROM e WHERE event_id IN (SELECT event_id FROM near)),", 1)


@query(
    f"""{_SHOWN} SELECT event_id, {_PREFIX} || host_t || ' sshd[' || thread_t || ']: ' || CASE event_type
        WHEN 'signup' THEN 'Accepted publickey for ' || user_t || ' from ' || client_t || ' port 22 ssh2'
        WHEN 'purchase' THEN 'Accepted password for ' || user_t || ' from ' || client_t || ' port 22 ssh2'
        WHEN 'error' THEN 'Failed password for ' || user_t || ' from ' || client_t || ' port 22 ssh2'
        WHEN 'view' THEN 'Connection closed by ' || client_t
        ELSE 'pam_unix(sshd:session): session opened for user ' || user_t || ' by (uid=' || uid_t || ')' END AS raw,
        CASE WHEN event_type = 'error' AND k = 7 THEN 'match' ELSE 'context' END AS kind
    FROM m"""
)
def masked_context(spark, sf_dir):
    """Matches and their neighbours, all masked; tokens are numbered over what is shown."""
    run = LogSearch(patterns=Patterns.of(r"Failed password for \w+ from 10\.0\.\d\.7 "), apps=(sshd.APP,), mask=True)
    return run.context(views.numbered(spark, sf_dir, daemons.SSHD), before=1, after=2).select("event_id", "raw", "kind")
