"""SSH daemon.

The rules follow the messages that OpenSSH's server writes, one for each kind of event: an
authentication attempt names its outcome and method, other messages name the peer.
"""

from logweave.operators.reports import Item, Pick, Where
from logweave.operators.rules import App, Rule

# A peer is an address and, in newer versions, a port; its user may be named as not valid or as
# already known.  A field that a filter can name takes part in every match of its rule, so messages with
# and without a user are different rules.
_PEER = "{client}(?: port {port:number})?"
_WHO = "(?:(?:invalid|authenticating) user )?{user}"


def _rule(name: str, text: str) -> Rule:
    # every message begins with the process id, which ties a session together
    return Rule(name, r"\[{thread:number}\]: " + text)


_AUTHENTICATION = (
    _rule("accepted", f"Accepted {{method:word}} for {{user}} from {_PEER}"),
    _rule("failed", f"Failed {{method:word}} for {_WHO} from {_PEER}"),
    _rule("unfinished", f"(?:Postponed|Partial) {{method:word}} for {_WHO} from {_PEER}"),
    _rule("too_many_failures", f"(?:error: )?maximum authentication attempts exceeded for {_WHO} from {_PEER}"),
    _rule("unknown_user", f"Invalid user {{user}} from {_PEER}"),
    _rule("not_allowed", f"User {{user}} from {{client}} not allowed because {{reason:text}}"),
    _rule("root_refused", f"ROOT LOGIN REFUSED FROM {_PEER}"),
)
_CONNECTION = (
    _rule("connection", f"Connection from {_PEER}"),
    _rule("closed_for_user", f"Connection (?:closed|reset) by (?:invalid|authenticating) user {{user}} {_PEER}"),
    _rule("closed", f"Connection (?:closed|reset) by {_PEER}"),
    _rule("disconnected_user", f"Disconnected from (?:(?:invalid|authenticating) )?user {{user}} {_PEER}"),
    _rule("disconnected", f"Disconnected from {_PEER}"),
    _rule("disconnect_by_peer", f"Received disconnect from {_PEER}: ?{{reason:text}}"),
    _rule("disconnecting", "Disconnecting[^:]*: {reason:text}"),
    _rule("no_banner", f"(?:Did not receive identification string from|banner exchange: Connection from) {_PEER}"),
    _rule("bad_banner", "Bad protocol version identification .* from " + _PEER),
    _rule("no_common_algorithm", f"Unable to negotiate with {_PEER}: {{reason:text}}"),
    _rule("timeout", f"(?:Timeout, client not responding|fatal: Timeout before authentication)[^0-9]* {_PEER}"),
    _rule("name_mismatch", r"reverse mapping checking getaddrinfo for {name:word} \[{client}\] failed"),
)
_SESSION = (
    # newer versions of the module add the id to the name
    _rule("session_opened", r"pam_unix\(\S+\): session opened for user {user}(?:\(uid=\d+\))? by .*\(uid={uid}\)"),
    _rule("session_closed", r"pam_unix\(\S+\): session closed for user {user}"),
    _rule("module_failure_of_user", r"pam_\w+\(\S+\): authentication failure; .*rhost={client}\s+user={user}"),
    _rule("module_failure", r"pam_\w+\(\S+\): authentication failure; .*rhost={client}"),
    _rule("session_started", f"Starting session: {{object:text}} for {{user}} from {_PEER}"),
    _rule("subsystem_of_user", "subsystem request for {object:word} by user {user}"),
    _rule("subsystem", "subsystem request for {object:word}"),
    _rule("traffic", "Transferred: sent {sent:number}, received {received:number} bytes"),
)
_SERVER = (
    _rule("listening", "Server listening on {client} port {port:number}"),
    _rule("terminated", "Received signal {signal:number}; terminating"),
    _rule("error", "(?:error|fatal): {reason:text}"),
)


def _logins(title: str, rule: str, root: bool) -> Item:
    """Table of one outcome by user, method, server and client; for root without the user."""
    where = Where("user", r"^root$", negate=not root)
    if root:
        pick, headers = Pick(rule, ("host", "method", "client"), where), ("Server", "Method", "Client")
    else:
        pick, headers = Pick(rule, ("user", "method", "host", "client"), where), ("User", "Access", "Server and client")
    return Item("login", title, "table", (pick,), headers)


APP = App(
    name="sshd",
    description="SSH daemon",
    tags=("sshd",),
    files=("${logdir}/secure*", "${logdir}/sshd*", "${logdir}/${host}/%Y/%m/secure-%Y%m%d.log*"),
    priority=0,
    rules=(*_AUTHENTICATION, *_CONNECTION, *_SESSION, *_SERVER),
    items=(
        _logins("Logins of users", "accepted", root=False),
        _logins("Logins of root", "accepted", root=True),
        _logins("Failed logins of users", "failed", root=False),
        _logins("Failed logins of root", "failed", root=True),
    ),
)
