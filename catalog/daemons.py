"""Lines of common daemons, made from the events table.

Each entry gives the message of every event type as SQL text that Spark and
DuckDB read alike, on the columns of ``views.EVENTS``.
"""

from __future__ import annotations

from catalog import views

USER = "CASE WHEN user_id % 10 = 0 THEN 'root' ELSE 'u' || (user_id % 20) END"
ADDRESS = "'10.0.' || (user_id % 5) || '.' || k"
QUEUE = "'Q' || lpad(CAST(event_id AS VARCHAR(20)), 10, '0')"
MAIL = "'u' || (user_id % 30) || '@d' || h || '.example.com'"
CLIENT = "'c' || (k % 20) || '.example.com'"


def _by_type(**messages: str) -> str:
    cases = " ".join(f"WHEN '{name}' THEN {text}" for name, text in messages.items())
    return f"CASE event_type {cases} END"


SSHD = "'sshd[' || event_id || ']: ' || " + _by_type(
    signup=f"'Accepted publickey for ' || {USER} || ' from ' || {ADDRESS} || ' port 22 ssh2'",
    purchase=f"'Accepted password for ' || {USER} || ' from ' || {ADDRESS} || ' port 22 ssh2'",
    error=f"'Failed password for ' || {USER} || ' from ' || {ADDRESS} || ' port 22 ssh2'",
    view=f"'Connection closed by ' || {ADDRESS}",
    click=f"'pam_unix(sshd:session): session opened for user ' || {USER} || ' by (uid=' || k || ')'",
)

_DELIVERY = (
    f"'postfix/smtp[' || user_id || ']: ' || {QUEUE} || ': to=<' || {MAIL} || '>, relay=mx.example.com'"
    " || '[10.0.0.1]:25, delay=1, delays=0/0/0/1, dsn=2.0.0, status='"
)
POSTFIX = _by_type(
    purchase=(
        f"'postfix/qmgr[' || user_id || ']: ' || {QUEUE} || ': from=<' || {MAIL} || '>, size=' || (v * 100)"
        " || ', nrcpt=1 (queue active)'"
    ),
    view=f"{_DELIVERY} || 'sent (250 ok)'",
    error=f"{_DELIVERY} || 'deferred (timed out)'",
    signup=f"'postfix/smtpd[' || user_id || ']: ' || {QUEUE} || ': client=' || {CLIENT} || '[10.0.0.' || k || ']'",
    click=f"'postfix/smtpd[' || user_id || ']: connect from ' || {CLIENT} || '[10.0.0.' || k || ']'",
)

_LOGIN = f"'user=<' || {USER} || '>, PID=' || event_id"
DOVECOT = _by_type(
    signup=f"'dovecot: imap-login: Login: ' || {_LOGIN} || ', TLS, rip=' || {ADDRESS} || ', lip=10.0.0.9'",
    purchase=f"'dovecot: pop3-login: Login: ' || {_LOGIN} || ', TLS, rip=' || {ADDRESS} || ', lip=10.0.0.9'",
    error=(
        f"'dovecot: imap-login: Aborted login (auth failed, 1 attempts): ' || {_LOGIN}"
        f" || ', method=PLAIN, rip=' || {ADDRESS} || ', lip=10.0.0.9'"
    ),
    view=f"'deliver(' || {USER} || '): msgid=<' || event_id || '@example.com>: saved mail to INBOX'",
    click=f"'dovecot: imap(' || {USER} || '): Connection closed bytes=' || v",
)

CRON = _by_type(
    signup=f"'crond[' || event_id || ']: (' || {USER} || ') CMD (/usr/bin/job ' || (k % 3) || ')'",
    purchase=f"'CROND[' || event_id || ']: (' || {USER} || ') CMD (/usr/bin/sync)'",
    view="'anacron[' || event_id || ']: Job finished'",
    error="'run-parts(/etc/cron.daily)[' || event_id || ']: starting ' || k",
    click="'atd[' || event_id || ']: idle'",
)

ASA = _by_type(
    signup=f"'%ASA-4-106023: Deny inbound udp from ' || {ADDRESS} || '/53 to 10.9.0.1/' || k || ' on interface inside'",
    purchase=f"'%ASA-5-111008: User ''' || {USER} || ''' executed the ''show run ' || k || ''' command'",
    view=f"'%ASA-6-605005: Login permitted from ' || {ADDRESS} || '/99 to inside:10.9.0.1/ssh for user \"' || {USER} || '\"'",
    error=(
        f"'%ASA-6-302014: Teardown TCP connection ' || event_id || ' for outside:' || {ADDRESS}"
        " || '/80 to inside:10.9.0.1/99 duration 0:00:10 bytes ' || v || ' TCP FINs'"
    ),
    click="'%ASA-7-609001: Built local-host ' || k",
)

BARRACUDA = _by_type(
    signup=(
        f"'scan[' || user_id || ']: ' || {CLIENT} || '[10.0.0.' || k || '] id-' || event_id || ' 1 2 SCAN - '"
        f" || {MAIL} || ' to@example.com - ' || (k % 6) || ' ' || v"
    ),
    purchase=(
        f"'inbound/pass1: ' || {CLIENT} || '[10.0.0.' || k || '] id-' || event_id || ' 1 2 SCAN - '"
        f" || {MAIL} || ' to@example.com - 2 ' || v"
    ),
    view="'outbound/smtp[' || user_id || ']: 127.0.0.1 id-' || event_id || ' 0 0 SEND - ' || (k % 5)",
    error=(
        f"'inbound/pass1[' || user_id || ']: ' || {CLIENT} || '[10.0.0.' || k || '] id-' || event_id"
        f" || ' 1 2 RCVD ' || {MAIL} || ' to@example.com 1 ' || v"
    ),
    click="'scan: nothing to do ' || k",
)

NTPD = _by_type(
    signup="'ntpd[1]: synchronized to 10.0.0.' || (k % 8) || ', stratum 2'",
    purchase="'ntpd[1]: synchronized to ntp.example.com, stratum 1'",
    error="'ntpd[1]: no servers reachable'",
    view="'ntpd[1]: time reset ' || v",
    click="'ntpd[1]: kernel time sync status ' || k",
)


def read(spark, sf_dir: str, message: str):
    """Unnumbered lines of one daemon."""
    return views.lines(spark, sf_dir, message)
