"""Cron daemon."""

from logweave.operators.reports import Item, Pick
from logweave.operators.rules import App, Rule

# The text of the daemon's messages and the title of its report.
APP = App(
    name="crond",
    description="Cron daemon",
    tags=("crond", "CROND", "anacron", "run-parts"),
    files=("${logdir}/cron*",),
    priority=9,
    rules=(Rule("command", r": \({user}\) CMD \((?P<command>[^)]*)\)"),),
    items=(
        Item(
            "command",
            "Cron Commands",
            "table",
            (Pick("command", ("host", "user", "command")),),
            ("Hostname", "User", "Commands"),
        ),
    ),
)
