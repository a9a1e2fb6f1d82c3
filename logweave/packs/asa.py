"""Cisco ASA security appliance.

Every message has a number, documented in the vendor's list of system messages; a rule takes the messages
of one or a few numbers.
"""

from logweave.operators.reports import Item, Pick
from logweave.operators.rules import App, Rule

def _message(name: str, numbers: str, text: str) -> Rule:
    return Rule(name, rf"^%ASA-\d-(?:{numbers}): {text}")


APP = App(
    name="asa",
    description="Cisco ASA security appliance",
    # all message numbers of the appliance begin like this
    tags=("%ASA-",),
    files=("${logdir}/${host}/%Y/%m/messages-%Y%m%d.log*",),
    priority=10,
    rules=(
        _message("command", "111008", "User '{user}' executed the '{command:quoted}' command"),
        _message("command_from", "111010", "User '{user}', running '[^']*' from IP {client}, executed '{command:quoted}'"),
        _message(
            "denied",
            "106\\d+",
            r"Deny (?:inbound )?{protocol:word} (?:src |from )(?:[^\s:/]+:)?{client1:client}/{port1:number} "
            r"(?:dst |to )(?:[^\s:/]+:)?{client2:client}/{port2:number}",
        ),
        _message(
            "built",
            "3020\\d\\d",
            r"Built (?:inbound|outbound) {protocol:word} connection {thread:number} for "
            r"{interface:interface}:{client1:client}/\d+ .*to [^\s:]+:{client2:client}/\d+",
        ),
        _message("torn_down", "3020\\d\\d", r"Teardown {protocol:word} connection {thread:number} for [^\s:/]+:{client1:client}/\d+ .*bytes {size:number}"),
        _message("login_denied", "605004", r"Login denied from {client}/\d+ to \S+ for user [\"']{user}[\"']"),
        _message("authentication_rejected", "113005|113015", "AAA user authentication Rejected : reason = {reason:clause} : .*user = {user}"),
        _message("login_permitted", "605005", r"Login permitted from {client}/\d+ to \S+ for user [\"']{user}[\"']"),
    ),
    fragments={"quoted": "[^']*", "clause": "[^:]+", "interface": r"[^\s:]+"},
    items=(
        Item("network", "Connections", "total", (
            Pick("built", ('"Built"',)), Pick("torn_down", ('"Torn down"',)),
            Pick("torn_down", ('"Bytes of those torn down"',), value="size", unit="B"), Pick("denied", ('"Denied"',)),
        )),
        Item("network", "Peers with most bytes", "top", (Pick("torn_down", ("client1",), value="size", add=True, unit="B"),), ("Peer",), top=5),
    ),
)
