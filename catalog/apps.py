"""Rule packs for the lines made from the events table."""

from logweave import App, Item, Pick, Rule, Where

_BODY = r"\[{thread:number}\]: k={code:number} v={amount:number}"

SHOP = App(
    name="shop",
    description="Orders and registrations",
    tags=("purchase", "signup"),
    priority=1,
    rules=(Rule("bought", "^purchase" + _BODY), Rule("registered", "^signup" + _BODY)),
    items=(
        Item(
            "mail",
            "Orders",
            "total",
            (
                Pick("bought", ('"All orders"',)),
                Pick("bought", ('"Orders with a code of 9x"',), Where("code", "^9[0-9]$")),
                Pick("bought", ('"Value of orders"',), value="amount", unit="B"),
            ),
        ),
        Item("mail", "Top hosts", "top", (Pick("bought", ("host",)),), ("Host",), 3),
        Item(
            "login",
            "Codes by host",
            "table",
            (Pick("registered", ("host", '"shop"', "code"), Where("code", "^[1-3]$")),),
            ("Host", "Service", "Code"),
        ),
    ),
)

WEB = App(
    name="web",
    description="Page views",
    tags=("view", "click"),
    priority=2,
    rules=(
        # only codes below 50 have a rule
        Rule("seen", r"^view\[{thread:number}\]: k=(?P<code>[1-4]?[0-9]) v={amount:number}"),
        Rule("clicked", "^click" + _BODY),
    ),
)

TROUBLE = App(
    name="trouble",
    description="Errors",
    tags=("error",),
    priority=3,
    rules=(Rule("failed", "^error" + _BODY),),
)

ALL = (SHOP, WEB, TROUBLE)
