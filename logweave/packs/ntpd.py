"""NTP daemon.  Not enabled unless it is asked for by name."""

from logweave.operators.reports import Item, Pick, Where
from logweave.operators.rules import App, Rule

APP = App(
    name="ntpd",
    description="NTP daemon",
    tags=("ntpd",),
    files=("${logdir}/${host}/%Y/%m/messages-%Y%m%d.log*",),
    enabled=False,
    priority=8,
    rules=(Rule("synchronized", ": synchronized to {client}, stratum"),),
    items=(
        Item(
            "query",
            "Time server",
            "total",
            (Pick("synchronized", ('"Times synchronized"',)),),
        ),
        Item(
            "query",
            "Peers most synchronized to",
            "top",
            (Pick("synchronized", ("client",), Where("client", "ntp.example.com", negate=True)),),
            ("Peer",),
            5,
        ),
    ),
)
