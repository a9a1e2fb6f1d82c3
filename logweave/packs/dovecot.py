"""Dovecot mail server.

Login processes write an event and then ``key=value`` parts; mail processes write the protocol, the user
and the event.  Both shapes are the same for all protocols, so a rule is about an event and takes the
protocol as a field.
"""

from logweave.operators.reports import Item, Pick, Where
from logweave.operators.rules import App, Rule

# One or two parts may come before those that a rule takes.
_PARTS = r"(?:[a-zA-Z]+(?:=[^,]*)?, )*"
_PEER = rf"{_PARTS}rip={{client}}(?:, lip={{lip:client}})?"
_SESSION = rf"user=<{{user}}>, {_PARTS}(?:m?pid|PID)={{thread:session}}"
_ENDED = r"(?:Login )?(?:[Aa]borted|Disconnected)[^(]*\({reason:attempts}\)"
_ATTEMPT = rf"(?:{_PARTS}(?:m?pid|PID)={{thread:session}}, )?{_PEER}"
# older versions write the process in upper case; newer ones add process and session ids
_PROCESS = r"^(?:dovecot(?:\[\d+\])?: )?{protocol:protocol}\({user}\)(?:<[^>]*><[^>]*>)?: "


def _login(name: str, text: str) -> Rule:
    return Rule(name, "{protocol:protocol}-login: " + text)


def _process(name: str, text: str) -> Rule:
    return Rule(name, _PROCESS + text)


_LOGINS = (
    _login("login", rf"Login: {_SESSION}, {_PEER}"),
    # a field that a filter can name takes part in every match, so attempts without a user are another rule
    _login("login_failed", rf"{_ENDED}: user=<{{user}}>, {_ATTEMPT}"),
    _login("login_not_tried", rf"{_ENDED}: {_ATTEMPT}"),
    _login("login_refused", rf"Maximum number of connections[^:]*: user=<{{user}}>, {_PEER}"),
    _login("login_ended", r"(?:Disconnected|Aborted login)(?:: {reason:clause})?"),
)
_MAILBOXES = (
    _process("saved", r"(?:sieve: )?msgid=<?{msgid:message}>?: (?:saved mail to|stored mail into mailbox) {folder:text}"),
    _process("save_failed", r"(?:sieve: )?msgid=<?{msgid:message}>?: (?:save failed to|failed to store into mailbox) {folder:text}"),
    _process("forwarded", r"(?:sieve: )?msgid=<?{msgid:message}>?: forwarded to <{mail}>"),
    _process("answered", r"(?:sieve: )?msgid=<?{msgid:message}>?: sent vacation response to <{mail}>"),
    _process("other_action", r"(?:sieve: )?msgid=<?{msgid:message}>?: {action:text}"),
    _process("indexed", "Indexed {num:number} messages in {folder:text}"),
)
_PROCESSES = (
    _process("closed", "(?:Connection closed|Logged out|Disconnected){reason:rest}"),
    _process("problem", "(?:Error|Warning|Fatal|Panic): {reason:text}"),
    Rule("server_problem", r"(?:Error|Warning|Fatal|Panic): {reason:text}"),
    Rule("child_ended", r"child {pid} \(\w+\) killed with signal {signal:number}"),
    Rule("started", r"(?:master: )?Dovecot v{version:word} .*starting up"),
)


def _by_user(title: str, rule: str) -> Item:
    where = Where("user", r"^root$", negate=True)
    pick = Pick(rule, ("user", "protocol", "host", "client"), where)
    return Item("login", title, "table", (pick,), ("User", "Access", "Server and client"))


APP = App(
    name="dovecot",
    description="Dovecot mail server",
    tags=("dovecot", "deliver"),
    files=("${logdir}/maillog*", "${logdir}/dovecot*", "${logdir}/${host}/%Y/%m/dovecot-%Y%m%d.log*"),
    priority=2,
    fragments={
        # the process id of a login also names its thread
        "session": "(?P<pid>${pid})",
        "protocol": "[A-Za-z0-9-]+",
        "attempts": "[^()]+",
        "clause": "[^:(]+",
        "rest": ".*",
        "message": "[^>:]+",
    },
    rules=(*_LOGINS, *_MAILBOXES, *_PROCESSES),
    items=(_by_user("Logins of users", "login"), _by_user("Failed logins of users", "login_failed")),
)
