"""Python patterns and their Java forms must agree."""

import re

import pytest
from pyspark.sql import functions as F

from logweave.functions.regex import captures_sql, expand, to_java
from logweave.operators.headers import BUILT_IN
from logweave.operators.rules import bind_rules
from logweave.packs import shipped

TEXTS = [
    "",
    "plain",
    "two words",
    "été à la plage",
    "naïve_x9 тест 42",
    "tab\tand\x0bmore",
    "a.b-c[d]&&e",
    "x" * 50 + "y",
    "١٢٣ digits",
    "no break space",
    "UPPER lower",
    "${not} $1 a name",
    "quote \" and ' here",
    "aXbXXcd\r",
]
PATTERNS = [
    r"\w+",
    r"^\w$",
    r"\d+",
    r"\s",
    r"\S+\s\S+",
    r"\bla\b",
    r"\Bt",
    r"[\w.-]+\[",
    r"[^\w\s]+",
    r"[^\W\d]+",
    r"[a&&b]+",
    r"a.c|b-c",
    r"(?i)upper LOWER",
    r"(?P<first_word>\w+) (?P<rest>.*)$",
    r"(x+)(?:y|z)?$",
    r"(?<=a)X(?=b)",
    r"(?<!a)X(?!c)",
    r"(X)\1",
    r"x{3,5}?",
    r"x{2}",
    r"[$]\{?\w+\}?",
    r"\Aplain\Z",
    r"(?P<q>['\"])",
    r"[\]\[\\^-]",
    r".\Z",
    r"[^\n]{12,}",
]


def test_search_agrees_with_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    found = df.select("t", *[to_java(p).test(F.col("t")).alias(f"p{i}") for i, p in enumerate(PATTERNS)])
    for row in found.collect():
        for i, pattern in enumerate(PATTERNS):
            assert row[f"p{i}"] == bool(re.search(pattern, row.t)), (pattern, row.t)


def test_ignore_case_is_unicode(spark):
    df = spark.createDataFrame([("ÉTÉ",), ("hiver",)], "t string")
    hit = to_java("été", ignore_case=True).test(F.col("t"))
    assert [r[0] for r in df.select(hit).collect()] == [True, False]


def test_first_match_and_groups_agree_with_python(spark):
    patterns = [
        r"(?P<a>\d+)(?:-(?P<b>\d+))?",
        r"(?P<a>x)|(?P<b>y(?P<c>z)?)",
        r"(?P<a>(?P<b>\w)\w*) (?P<c>.+)",
        r"^(?:(?P<a>\w+): )?(?P<b>[a-z]*)",
        r"<(?P<a>)(?P<b>[^>]*)>",
    ]
    texts = ["12-34", "7", "yz", "ab cd ef", "key: value", "VALUE", "<>", "<tag> x y", "q"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in patterns:
        regex = to_java(pattern)
        written = ["hit"]
        for g in regex.groups:
            written += [f"${g.index}", f"${g.guard}" if g.guard else "1"]
        parts = df.selectExpr("t", captures_sql("t", [(regex, "\n".join(written))]) + " AS p")
        for row in parts.collect():
            match = re.search(pattern, row.t)
            assert (len(row.p) > 1) == bool(match), (pattern, row.t)
            if match:
                values = {
                    g.name: row.p[2 * i + 1] if row.p[2 * i + 2] else None
                    for i, g in enumerate(regex.groups)
                }
                assert values == match.groupdict(), (pattern, row.t)


def test_unsupported_constructs_are_refused():
    with pytest.raises(ValueError, match="invalid pattern"):
        to_java("(")
    with pytest.raises(ValueError, match="not supported"):
        to_java(r"(a)?(?(1)b|c)")


def test_expand():
    names = {"A": "x${B}", "B": "[0-9]", "C": "${D}", "D": "${C}"}
    assert expand("^${A}$ $$ $A", names) == "^x[0-9]$ $$ $A"
    with pytest.raises(ValueError, match="circular"):
        expand("${C}", names)
    with pytest.raises(ValueError, match="unknown name"):
        expand("${E}", names)


# one line or more for every rule of every pack
RULE_LINES = {
    "sshd": [
        "sshd[1]: Accepted publickey for ann from 10.0.0.1 port 2 ssh2: ED25519 SHA256:abc",
        "sshd[1]: Accepted password for bob.x from host-1.example.com",
        "sshd[1]: Accepted keyboard-interactive/pam for ann from ::1 port 2 ssh2",
        "sshd[2]: Failed password for ann from gate port 2 ssh2",
        "sshd[2]: Failed password for invalid user eve from 10.0.0.9 port 3 ssh2",
        "sshd[2]: Postponed publickey for ann from 10.0.0.9 port 3 ssh2 [preauth]",
        "sshd[2]: error: maximum authentication attempts exceeded for invalid user eve from 10.0.0.9 port 3 ssh2",
        "sshd[2]: Invalid user eve from 10.0.0.9 port 3",
        "sshd[2]: User ann from 10.0.0.9 not allowed because not listed in AllowUsers",
        "sshd[2]: ROOT LOGIN REFUSED FROM 10.0.0.9 port 3",
        "sshd[3]: Connection from 10.0.0.9 port 3 on 10.0.0.1 port 22",
        "sshd[3]: Connection closed by 10.0.0.9 [preauth]",
        "sshd[3]: Connection reset by invalid user eve 10.0.0.9 port 3 [preauth]",
        "sshd[3]: Disconnected from user ann 10.0.0.9 port 3",
        "sshd[3]: Disconnected from 10.0.0.9 port 3",
        "sshd[3]: Received disconnect from 10.0.0.9 port 3:11: disconnected by user",
        "sshd[3]: Disconnecting invalid user eve 10.0.0.9 port 3: Too many authentication failures",
        "sshd[3]: Did not receive identification string from 10.0.0.9 port 3",
        "sshd[3]: Bad protocol version identification 'GET / HTTP' from 10.0.0.9 port 3",
        "sshd[3]: Unable to negotiate with 10.0.0.9 port 3: no matching key exchange method found.",
        "sshd[3]: fatal: Timeout before authentication for 10.0.0.9 port 3",
        "sshd[3]: reverse mapping checking getaddrinfo for h.example.com [10.0.0.9] failed.",
        "sshd[3]: pam_unix(sshd:session): session opened for user ann(uid=7) by (uid=0)",
        "sshd[3]: pam_unix(sshd:session): session closed for user ann",
        "sshd[3]: pam_unix(sshd:auth): authentication failure; uid=0 tty=ssh ruser= rhost=h1  user=ann",
        "sshd[3]: pam_unix(sshd:auth): authentication failure; uid=0 tty=ssh ruser= rhost=h1",
        "sshd[3]: subsystem request for sftp",
        "sshd[3]: Starting session: shell on pts/0 for ann from 10.0.0.9 port 3 id 0",
        "sshd[3]: subsystem request for sftp by user ann",
        "sshd[3]: Transferred: sent 1000, received 2000 bytes",
        "sshd[3]: Server listening on 0.0.0.0 port 22.",
        "sshd[3]: Received signal 15; terminating.",
        "sshd[3]: error: kex_exchange_identification: read: x",
        "sshd: something else",
    ],
    "postfix": [
        "postfix/smtpd[9]: 0123456789A: client=h1.example.com[10.0.0.1]",
        "postfix/pickup[9]: 4bXyZk2wQzz1: uid=0 from=<root>",
        "postfix/cleanup[9]: 0123456789A: message-id=<1@x>",
        "postfix/qmgr[9]: 0123456789A: from=<ann@example.com>, size=120, nrcpt=2 (queue active)",
        "postfix/qmgr[9]: 0123456789A: from=<a@x.org>, status=expired, returned to sender",
        "postfix/bounce[9]: 0123456789A: sender non-delivery notification: 0123456789B",
        "postfix/qmgr[9]: 0123456789A: removed",
        "postfix/smtp[9]: 0123456789A: to=<bob@x.org>, relay=r[1.2.3.4]:25, delay=1, delays=1/0/0/1, dsn=2.0.0, status=sent (ok)",
        "postfix/smtp[9]: 0123456789A: to=<bob@x.org>, relay=none, delay=1, delays=1/0/0/1, dsn=4.0.0, status=deferred (no)",
        "postfix/local[9]: 0123456789A: to=<b@x.org>, orig_to=<c@x.org>, relay=local, delay=1, dsn=5.0.0, status=bounced (user unknown)",
        "postfix/smtp[9]: 0123456789A: host mx[1.2.3.4] said: 450 too many mails (in reply to RCPT TO command)",
        "postfix/smtp[9]: 0123456789A: lost connection with mx[1.2.3.4] while receiving the initial server greeting",
        "postfix/smtpd[9]: NOQUEUE: reject: RCPT from h1[10.0.0.1]: 554 5.7.1 x",
        "postfix/cleanup[9]: 0123456789A: milter-reject: END-OF-MESSAGE from h1: 5.7.1 x",
        "postfix/smtpd[9]: NOQUEUE: discard: RCPT from h1: x",
        "postfix/smtpd[9]: connect from h1.example.com[10.0.0.1]",
        "postfix/smtpd[9]: disconnect from h1.example.com ehlo=1 quit=1 commands=2",
        "postfix/smtp[9]: connect to mx.x.org[1.2.3.4]:25: Connection timed out",
        "postfix/smtpd[9]: lost connection after DATA from h1",
        "postfix/smtpd[9]: Anonymous TLS connection established from h1[10.0.0.1]: TLSv1.3 with cipher x",
        "postfix/smtpd[9]: SSL_accept error from h1[10.0.0.1]: -1",
        "postfix/anvil[9]: statistics: max connection rate 1/60s for (smtp:10.0.0.1) at Jan 1",
        "postfix/smtpd[9]: table hash:/etc/aliases(0,34) has changed -- restarting",
        "postfix/smtpd[9]: warning: hostname x does not resolve",
        "postfix/master[9]: daemon started -- version 3.8.1, configuration /etc/postfix",
        "postfix/smtpd[9]: something else",
    ],
    "dovecot": [
        "dovecot: imap-login: Login: user=<ann>, method=PLAIN, rip=10.0.0.1, lip=10.0.0.2, mpid=12, TLS",
        "dovecot: imap-login: Login: user=<ann>, PID=12, TLS, rip=10.0.0.1, lip=10.0.0.2",
        "dovecot: pop3-login: Login: user=<ann>, method=PLAIN, mpid=12, rip=10.0.0.1",
        "dovecot: imap-login: Disconnected (auth failed, 1 attempts in 2 secs): user=<ann>, method=PLAIN, rip=1.1.1.1, lip=2.2.2.2",
        "dovecot: imap-login: Aborted login (no auth attempts): PID=1, rip=1.1.1.1, lip=2.2.2.2",
        "dovecot: imap-login: Maximum number of connections from user+IP exceeded (mail_max_userip_connections=10): user=<ann>, method=PLAIN, rip=1.1.1.1, lip=2.2.2.2",
        "dovecot: imap-login: Disconnected: Connection closed: SSL_accept failed",
        "dovecot: lda(ann)<7><ab+c>: sieve: msgid=<1@x>: stored mail into mailbox 'INBOX'",
        "deliver(ann): msgid=<1@x>: saved mail to INBOX",
        "deliver(ann): msgid=<1@x>: save failed to INBOX: x",
        "deliver(ann): msgid=<1@x>: forwarded to <b@x.org>",
        "deliver(ann): msgid=<1@x>: sent vacation response to <b@x.org>",
        "deliver(ann): msgid=<1@x>: discarded duplicate",
        "dovecot: indexer-worker(ann)<7><x>: Indexed 5 messages in INBOX",
        "dovecot: imap(ann)<7><x>: Logged out in=10 out=20",
        "dovecot: IMAP(ann): Disconnected: Logged out",
        "dovecot: pop3(ann): Error: x",
        "dovecot: master: Error: service(imap): x",
        "dovecot: child 12 (imap) killed with signal 9",
        "dovecot: master: Dovecot v2.3.20 (x) starting up for imap, lmtp",
        "dovecot: something else",
    ],
    "asa": [
        "%ASA-5-111008: User 'ann' executed the 'show run' command",
        "%ASA-5-111010: User 'ann', running 'CLI' from IP 1.1.1.1, executed 'show run'",
        "%ASA-4-106023: Deny inbound udp from 1.1.1.1/53 to 2.2.2.2/99 on interface x",
        "%ASA-4-106023: Deny tcp src outside:1.1.1.1/53 dst inside:2.2.2.2/99 by access-group x",
        "%ASA-6-302015: Built outbound UDP connection 5 for outside:1.1.1.1/53 (1.1.1.1/53) to inside:2.2.2.2/53 (2.2.2.2/99)",
        "%ASA-6-302014: Teardown TCP connection 5 for outside:1.1.1.1/53 to inside:2.2.2.2/53 duration 0:00:30 bytes 4711 TCP FINs",
        "%ASA-4-605004: Login denied from 1.1.1.1/99 to inside:2.2.2.2/ssh for user \"ann\"",
        "%ASA-6-113005: AAA user authentication Rejected : reason = Invalid password : server = 3.3.3.3 : user = ann",
        "%ASA-6-605005: Login permitted from 1.1.1.1/99 to inside:2.2.2.2/ssh for user \"ann\"",
        "%ASA-7-609001: Built local-host inside:1.1.1.1",
    ],
    "barracuda": [
        "scan[7]: h1[1.1.1.1] 123-456 1 2 SCAN - a@x.org b@x.org - 2 17",
        "outbound/smtp: 127.0.0.1 123-456 0 0 SEND - 3 x",
        "inbound/pass1[7]: h1[1.1.1.1] 123-456 1 2 RCVD a@x.org b@x.org 1 17",
    ],
    "crond": ["CROND[8]: (root) CMD (run-parts /etc/cron.hourly)", "crond[8]: x"],
    "ntpd": ["ntpd[8]: synchronized to 1.1.1.1, stratum 2"],
}


@pytest.mark.parametrize("app", shipped(), ids=lambda a: a.name)
def test_rules_agree_with_python(spark, app):
    """First matching rule and all groups, as Python's re sees them; every rule is reached."""
    from logweave.operators.headers import parse_headers
    from logweave.operators.rules import apply_rules

    texts = RULE_LINES[app.name]
    rules = bind_rules(app)
    rows = [(f"Jan  1 00:00:00 gate {t}", t) for t in texts]
    df = spark.createDataFrame(rows, "raw string, message_in string").selectExpr(
        "*", "timestamp '2015-06-01 00:00:00' AS file_mtime"
    )
    got = apply_rules(parse_headers(df), [app]).select("message_in", "message", "rule", "fields").collect()
    reached = set()
    for row in got:
        assert row.message == row.message_in
        first = next((r for r in rules if re.search(r.pattern, row.message)), None)
        assert row.rule == (first.name if first else None), row.message
        if first:
            assert row.fields == re.search(first.pattern, row.message).groupdict(), row.message
            reached.add(first.name)
    assert reached == {r.name for r in rules}


@pytest.mark.parametrize("fmt", BUILT_IN, ids=lambda f: f.name)
def test_headers_agree_with_python(spark, fmt):
    lines = [
        "<13>Feb  5 17:32:18 10.0.0.99 Use the BFG!",
        "Feb 30 17:32:18 h x[1]: y",
        "Feb  5 17:32:18 last message repeated 12 times",
        "<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su - ID47 - 'su root' failed",
        "2003-10-11T22:14:15+02:00 - app 12 - text",
        "<1>-10:11:12Z h a p m ",
        "not a header",
        "",
    ]
    df = spark.createDataFrame([(t,) for t in lines], "raw string")
    found = df.select("raw", F.col("raw").rlike(r"\A" + fmt.regex.body).alias("hit"))
    for row in found.collect():
        assert row.hit == bool(re.match(fmt.pattern, row.raw)), row.raw
