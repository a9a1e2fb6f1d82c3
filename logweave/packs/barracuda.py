"""Barracuda spam and virus firewall.

A line of the mail log names a process, the peer, the message id, begin and end, and one of three services
with its parts: ``RECV``/``RCVD``, ``SCAN`` or ``SEND``.  The codes of actions are those of the vendor's
syslog documentation.
"""

from logweave.operators.reports import Item, Pick, Where
from logweave.operators.rules import App, Rule

# The action codes of the documentation.
_ACTIONS = {
    "0": "Allowed",
    "1": "Aborted",
    "2": "Blocked",
    "3": "Quarantined",
    "4": "Tagged",
    "5": "Deferred",
    "6": "Deferred by user",
    "7": "Allowed by user",
    "8": "Whitelisted",
}
_HEAD = r"^[\w/]+(?:\[{pid}\])?: {client} {thread:message} \d+ \d+ "


def _top(size: int, title: str, header: str, field: str) -> Item:
    return Item("mail", f"Spam firewall: {title}", "top", (Pick("scanned", (field,)),), (header,), size)


APP = App(
    name="barracuda",
    description="Barracuda spam and virus firewall",
    tags=("scan", "outbound/smtp", "inbound/pass1"),
    files=("${logdir}/${host}/%Y/%m/maillog-%Y%m%d.log*",),
    priority=10,
    fragments={"message": "[-0-9A-Za-z]+", "code": r"\d"},
    rules=(
        Rule("scanned", _HEAD + r"SCAN \S+ {from} {rcpt} \S+ {action:code} {reason:number}"),
        Rule("received", _HEAD + r"(?:RECV|RCVD) {from} {rcpt} {action:code} {reason:number}"),
        Rule("sent", _HEAD + r"SEND \S+ {action:code}"),
    ),
    items=(
        Item(
            "mail",
            "Spam firewall in numbers",
            "total",
            (
                Pick("scanned", ('"Scanned"',)),
                *(Pick("scanned", (f'"{t}"',), Where("action", f"^{c}$")) for c, t in _ACTIONS.items()),
                Pick("sent", ('"Sending put off"',), Where("action", "^3$")),
            ),
        ),
        _top(5, "clients", "Client", "client"),
        _top(10, "senders", "Sender", "from"),
        _top(10, "recipients", "Recipient", "rcpt"),
    ),
)
