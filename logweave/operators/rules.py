"""Rule packs, routing of lines to applications, and field extraction."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.regex import JavaRegex, captures_sql, compute_once, expand, sql_text, to_java
from logweave.operators.joins import BROADCAST_ROWS, join_checked, stage
from logweave.operators.ordered import Running, chunk_of, running
from logweave.packs.fields import FIELDS, FRAGMENTS

Filter = dict[str, str]

# Lines whose weights are held together, and weights that are broadcast in such arrays, at some 30 bytes each.
NOTICE_LINES, ARRAY_NOTICES = 256, 8_000_000


@dataclass(frozen=True)
class Rule:
    """A named pattern for the message part of a line.

    ``{user}`` stands for a group named ``user`` that matches the field or fragment
    ``user``; ``{client1:client}`` names the group otherwise.  Python's
    ``(?P<user>${user})`` means the same.  The group ``thread`` ties lines together.
    """

    name: str
    text: str

    @property
    def template(self) -> str:
        def group(m: re.Match) -> str:
            return f"(?P<{m[1]}>${{{m[2] or m[1]}}})"

        return re.sub(r"(?<!\$)\{([A-Za-z_]\w*)(?::([A-Za-z_]\w*))?\}", group, self.text)

    @property
    def group_names(self) -> tuple[str, ...]:
        return tuple(re.findall(r"\(\?P<(\w+)>", self.template))


@dataclass(frozen=True)
class App:
    """A rule pack: which tags it owns, where its files are, its rules and report items."""

    name: str
    description: str
    tags: tuple[str, ...]
    rules: tuple[Rule, ...]
    files: tuple[str, ...] = ()
    enabled: bool = True
    priority: int = 10
    items: tuple = ()
    fields: dict[str, str] = field(default_factory=dict, hash=False)
    fragments: dict[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if not self.rules:
            raise ValueError(f"app {self.name!r} has no rules")
        if not self.tags or not all(self.tags):
            raise ValueError(f"app {self.name!r} has an empty tag")
        names = [r.name for r in self.rules]
        if len(set(names)) < len(names):
            raise ValueError(f"app {self.name!r} has two rules of one name")


@dataclass(frozen=True)
class BoundRule:
    """A rule with its fragments filled in, possibly narrowed by a field filter."""

    app: str
    name: str
    pattern: str
    filter_keys: tuple[str, ...] = ()
    full: bool = True

    @cached_property
    def regex(self) -> JavaRegex:
        return to_java(self.pattern)


def parse_filter(text: str) -> Filter:
    """``field=regex[,field=regex]`` as a filter group; all of a group must hold."""
    group = {}
    for part in text.split(","):
        name, eq, pattern = part.partition("=")
        pattern = pattern.strip("'\"")
        if not eq or not name or not pattern:
            raise ValueError(f"filter {part!r}: use field=pattern")
        to_java(pattern)
        group[name.lower()] = pattern
    return group


def bind_rules(app: App, filters: Iterable[Filter] = (), threads: bool = False) -> list[BoundRule]:
    """Rules with all names expanded.

    Under filters a rule is repeated for each group, with the filter patterns in
    place of the fields they name.  Rules that do not use every field of the group
    are dropped, or, when threads are wanted, kept as rules that tell the thread
    but do not select.  Filter rules are tried first.
    """
    names = FRAGMENTS | FIELDS | app.fragments | app.fields
    filters = list(filters)
    known = FIELDS | app.fields
    for group in filters:
        if undefined := [f for f in group if f not in known]:
            raise ValueError(f"undefined fields: {undefined}")
    if not filters:
        return [BoundRule(app.name, r.name, expand(r.template, names)) for r in app.rules]
    narrowed, others = [], []
    for rule in app.rules:
        for group in filters:
            if all(f"${{{f}}}" in rule.template for f in group):
                pattern = rule.template
                for f, regex in group.items():
                    pattern = pattern.replace(f"${{{f}}}", f"(?:{regex})")
                keys = tuple(f for f in group if f in rule.group_names)
                narrowed.append(BoundRule(app.name, rule.name, expand(pattern, names), keys))
        if threads:
            others.append(BoundRule(app.name, rule.name, expand(rule.template, names), full=False))
    return narrowed + others


def choose_apps(apps: Iterable[App], names: Iterable[str] = ()) -> list[App]:
    """The named apps, or all enabled ones, by (priority, name)."""
    apps, names = list(apps), list(names)
    if unknown := set(names) - {a.name for a in apps}:
        raise ValueError(f"unknown apps: {sorted(unknown)}")
    chosen = [a for a in apps if (a.name in names if names else a.enabled)]
    return sorted(chosen, key=lambda a: (a.priority, a.name))


@dataclass(frozen=True)
class _Routes:
    """SQL conditions that tell which apps a line may belong to.

    ``prepare`` adds what they share: whether the tag says nothing (``_no_tag``),
    whether an app owns it (``_owned``), and the app to fall back on (``_first``).
    """

    apps: tuple[App, ...]
    has_bound: bool = False

    @classmethod
    def of(cls, events: DataFrame, apps: Iterable[App]) -> _Routes:
        ordered = tuple(sorted(apps, key=lambda a: (a.priority, a.name)))
        return cls(ordered, "format_app" in events.columns)

    @staticmethod
    def _owns(app: App) -> str:
        return f"apptag IN ({', '.join(sql_text(t) for t in app.tags)})"

    @staticmethod
    def _begins(app: App) -> str:
        return "(" + " OR ".join(f"startswith(apptag, {sql_text(t)})" for t in app.tags) + ")"

    def prepare(self, events: DataFrame) -> DataFrame:
        no_tag = r"(apptag IS NULL OR apptag = '-' OR rlike(apptag, r'\A\p{Nd}+\z'))"
        owned = " OR ".join(self._owns(a) for a in self.apps)
        first = f"CASE WHEN {no_tag} THEN NULL"
        for test in (self._owns, self._begins):
            first += "".join(f" WHEN {test(a)} THEN {sql_text(a.name)}" for a in self.apps)
        first += " END"
        if self.has_bound:
            names = ", ".join(sql_text(a.name) for a in self.apps)
            first = f"CASE WHEN format_app IN ({names}) THEN format_app ELSE {first} END"
        return events.selectExpr(
            "*", f"{no_tag} AS _no_tag", f"coalesce({owned}, false) AS _owned", f"{first} AS _first"
        )

    def may_be(self, app: App) -> str:
        test = f"(_no_tag OR CASE WHEN _owned THEN {self._owns(app)} ELSE {self._begins(app)} END)"
        if self.has_bound:
            test = f"CASE WHEN format_app IS NULL THEN {test} ELSE format_app = {sql_text(app.name)} END"
        return test

    def candidates(self) -> str:
        """Number of apps a line may belong to."""
        return " + ".join(f"CAST({self.may_be(a)} AS INT)" for a in self.apps)


def _chain(rules: list[BoundRule], numbers: dict[int, int]) -> str:
    """First matching rule of an app: its number, then its groups; null without a match.

    A rule is tried only on lines that hold the text all its matches have, and the
    groups of the one rule that matches are taken in a single run.
    """
    cases = []
    for rule in rules:
        values = [f"${g.index}" for g in rule.regex.groups]
        guards = [f"${g.guard}" for g in rule.regex.groups if g.guard]
        text = "\n".join([str(numbers[id(rule)]), *values, *guards])
        test = rule.regex.test_sql("message")
        cases.append(f"WHEN {test} THEN {captures_sql('message', [(rule.regex, text)])}")
    return f"CASE {' '.join(cases)} END"


def _texts(values: Iterable[str]) -> str:
    return f"array({', '.join(sql_text(v) for v in values)})"


def _fields_sql(rules: list[BoundRule]) -> str:
    """The map of group names to values; a group that took no part is null.

    ``_hit`` holds the rule number, the values and then a guard for each group in
    an optional part of the rule.
    """
    names = "array(" + ", ".join(
        f"CAST({_texts(g.name for g in r.regex.groups)} AS array<string>)" for r in rules
    ) + ")"
    names = f"get({names}, _no)"
    sizes = f"get(array({', '.join(str(len(r.regex.groups)) for r in rules)}), _no)"
    plain = f"map_from_arrays({names}, slice(_hit, 2, {sizes}))"
    guarded = [i for i, r in enumerate(rules) if any(g.guard for g in r.regex.groups)]
    if not guarded:
        return plain
    # place of the guard of each group, 0 for a group that always takes part
    places = []
    for rule in rules:
        place, own = len(rule.regex.groups), []
        for g in rule.regex.groups:
            place += 1 if g.guard else 0
            own.append(str(place if g.guard else 0))
        places.append(f"CAST(array({', '.join(own)}) AS array<int>)")
    guards = f"get(array({', '.join(places)}), _no)"
    values = (
        f"zip_with(slice(_hit, 2, {sizes}), {guards},"
        " (v, g) -> CASE WHEN g = 0 OR get(_hit, g) <> '' THEN v END)"
    )
    return f"CASE WHEN _no IN ({', '.join(map(str, guarded))}) THEN map_from_arrays({names}, {values}) ELSE {plain} END"


def apply_rules(
    events: DataFrame,
    apps: Iterable[App],
    filters: Iterable[Filter] = (),
    threads: bool = False,
) -> DataFrame:
    """Route lines to apps and extract fields by the first rule that matches.

    Adds ``app, rule, thread, fields, matched, full_match``.  A tag that one app
    owns decides alone.  With several candidates (a shared tag, a tag that starts
    with an owned one, or no usable tag) the first app with a matching rule wins;
    if none has one, a usable tag falls to the first candidate and the others
    stay without app.  Everything is done row by row: no join, no shuffle.
    """
    routes = _Routes.of(events, apps)
    filters = list(filters)
    bound = [bind_rules(a, filters, threads) for a in routes.apps]
    flat = [r for rules in bound for r in rules]
    df = routes.prepare(events)
    kept = [f"`{c}`" for c in events.columns]
    if not flat:
        none = ("rule string", "thread string", "fields map<string,string>")
        return df.selectExpr(
            *kept, "_first AS app", *[f"CAST(NULL AS {n.split()[1]}) AS {n.split()[0]}" for n in none],
            "false AS matched", "false AS full_match",
        )
    numbers = {id(r): i for i, r in enumerate(flat)}
    tries = [
        f"CASE WHEN {routes.may_be(app)} THEN {_chain(rules, numbers)} END"
        for app, rules in zip(routes.apps, bound, strict=True)
        if rules
    ]
    df = compute_once(df, "_hit", f"coalesce({', '.join(tries)})", apart=True)
    df = df.selectExpr("*", "CAST(get(_hit, 0) AS INT) AS _no")
    columns = [
        f"get({_texts(r.app for r in flat)}, _no) AS _app",
        f"get({_texts(r.name for r in flat)}, _no) AS rule",
        f"{_fields_sql(flat)} AS fields",
    ]
    if not filters:
        df = df.selectExpr(*kept, "_first", "_no", *columns)
        return df.selectExpr(
            *kept, "coalesce(_app, _first) AS app", "rule", "fields['thread'] AS thread", "fields",
            "_no IS NOT NULL AS matched", "_no IS NOT NULL AS full_match",
        )
    # a filter rule whose field took no part is a miss, and later rules are not tried
    keys = ", ".join(f"CAST({_texts(r.filter_keys)} AS array<string>)" for r in flat)
    keys = f"get(array({keys}), _no)"
    full = f"get(array({', '.join(str(r.full).lower() for r in flat)}), _no)"
    part = f"coalesce(forall({keys}, k -> fields[k] IS NOT NULL), false) AS matched"
    df = df.selectExpr(*kept, "_first", "_no", *columns).selectExpr("*", part)
    hit = lambda c: f"CASE WHEN matched THEN {c} END"
    return df.selectExpr(
        *kept, f"coalesce({hit('_app')}, _first) AS app", f"{hit('rule')} AS rule",
        f"{hit("fields['thread']")} AS thread", f"{hit('fields')} AS fields", "matched",
        f"coalesce(matched AND {full}, false) AS full_match",
    )


def route(events: DataFrame, apps: Iterable[App]) -> DataFrame:
    """Only the ``app`` of each line: rules run where the tag alone does not decide."""
    routes = _Routes.of(events, apps)
    df = routes.prepare(events)
    open_ = f"(_no_tag OR {routes.candidates()} > 1)"
    if routes.has_bound:
        open_ = f"(format_app IS NULL AND {open_})"
    cases = []
    for app in routes.apps:
        found = " OR ".join(f"({r.regex.test_sql('message')})" for r in bind_rules(app))
        cases.append(f"WHEN {routes.may_be(app)} AND ({found}) THEN {sql_text(app.name)}")
    app = f"coalesce(CASE WHEN {open_} THEN CASE {' '.join(cases)} END END, _first)"
    return compute_once(df, "app", app).drop("_no_tag", "_owned", "_first")


def extra_tags(events: DataFrame, apps: Iterable[App]) -> DataFrame:
    """Tags that no app owns, with the number of lines."""
    lost = "NOT _no_tag AND _first IS NULL"
    found = _Routes.of(events, apps).prepare(events).filter(lost)
    return found.groupBy("apptag").agg(F.count(F.lit(1)).alias("lines"))


def select_mode(parsed: DataFrame, mode: str = "ruled") -> Column:
    """Condition for selected lines: ``ruled``, ``unparsed`` or ``unruled``."""
    known = F.col("app").isNotNull()
    if mode == "ruled":
        return F.col("matched") & F.col("full_match")
    if mode == "unparsed":
        return known & ~F.col("matched")
    if mode == "unruled":
        return known
    raise ValueError(f"unknown mode {mode!r}")


def app_counters(parsed: DataFrame) -> DataFrame:
    """Per app: events that a rule matched, and events that none did."""
    weight = F.col("weight") if "weight" in parsed.columns else F.lit(1)
    hit = F.col("matched")
    return (
        parsed.filter(F.col("app").isNotNull())
        .groupBy("app")
        .agg(
            F.coalesce(F.sum(F.when(hit, weight)), F.lit(0)).alias("matches"),
            F.coalesce(F.sum(F.when(~hit, weight)), F.lit(0)).alias("unparsed"),
        )
    )


def fold_repeats(parsed: DataFrame) -> DataFrame:
    """Turn "last message repeated N times" lines into a weight of the line before.

    ``parsed`` holds all lines of the files, those of unknown format too, which
    are skipped over.  The result holds the lines of known format without the
    notices; ``weight`` is 1 plus the repetitions.  Of several notices in a row
    only the first counts.

    Only notices and unknown lines are shuffled.  A stretch of such lines ends
    just after the line the notice is about, whose number is then known.  The
    weights are broadcast, each by itself or, if they are many, as one array for
    every ``NOTICE_LINES`` lines.  Beyond that, only stretches of lines that hold a
    weight move to them.
    """
    odd = parsed.filter(F.col("format").isNull() | F.col("repeat").isNotNull())
    odd = stage(odd.select("file", "line_no", "repeat"))
    ranked = running(odd, ["file"], [Running("_rank", "sum", F.lit(1))])
    notice = F.when(F.col("repeat").isNotNull(), F.struct("line_no", "repeat"))
    about = (
        ranked.groupBy("file", (F.col("line_no") - F.col("_rank")).alias("_stretch"))
        .agg((F.min("line_no") - 1).alias("line_no"), F.min(notice)["repeat"].alias("_times"))
        .filter("_times is not null and line_no > 0")
        .select("file", "line_no", "_times")
    )
    plain = parsed.filter(F.col("format").isNotNull() & F.col("repeat").isNull())
    return add_weights(plain, stage(about))


def add_weights(
    plain: DataFrame,
    about: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    array_rows: int = ARRAY_NOTICES,
    notice_lines: int = NOTICE_LINES,
) -> DataFrame:
    """Lines with ``weight``: 1, plus the ``_times`` that ``about`` has for a ``file`` and ``line_no``."""
    columns = [F.col(c) for c in plain.columns]
    count = about.count()
    if count <= broadcast_rows:
        found = plain.join(F.broadcast(about), ["file", "line_no"], "left")
        return found.select(*columns, (F.lit(1) + F.coalesce("_times", F.lit(0))).cast("bigint").alias("weight"))
    stretch = chunk_of(lines=notice_lines).alias("_chunk")
    of_lines = about.select("file", stretch, F.struct("line_no", "_times").alias("_notice"))
    of_lines = of_lines.groupBy("file", "_chunk").agg(F.collect_list("_notice").alias("_notices"))
    own = F.filter("_notices", lambda n: n["line_no"] == F.col("line_no"))
    weight = (F.lit(1) + F.coalesce(F.get(own, F.lit(0))["_times"], F.lit(0))).cast("bigint").alias("weight")
    plain = plain.withColumn("_chunk", stretch)
    if count <= array_rows:
        found = plain.join(F.broadcast(of_lines), ["file", "_chunk"], "left")
        return found.select(*columns, weight)
    # large chunks tell where weights are; the lines of the others are read again and stay where they are
    chunks = about.select("file", chunk_of().alias("_large"), F.lit(True).alias("_near")).distinct()
    marked = join_checked(plain.withColumn("_large", chunk_of()), chunks, ["file", "_large"], "left", hot_rows=None)
    near = marked.filter("_near").drop("_near", "_large").join(of_lines, ["file", "_chunk"], "left")
    far = marked.filter("_near is null").select(*columns, F.lit(1).cast("bigint").alias("weight"))
    return near.select(*columns, weight).unionByName(far)


def rule_results(
    selected: DataFrame, needed: dict[tuple[str, str], set[str] | None] | None = None
) -> DataFrame:
    """Events per (app, rule, host, fields): the counters all reports are made from.

    ``needed`` names, per app and rule, the fields that will be asked for (None for
    all).  Other rules are left out, and other fields do not keep counters apart: a
    process id in the key would make a counter of nearly every line.
    """
    weight = F.col("weight") if "weight" in selected.columns else F.lit(1)
    if needed is not None:
        selected = _only_needed(selected, needed)
    return selected.groupBy("app", "rule", "host", "fields").agg(
        F.sum(weight).cast("bigint").alias("events")
    )


def lines_of_rules(selected: DataFrame, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """What counters are made from, of the lines that the given rules matched."""
    return _only_needed(selected, dict.fromkeys(rules))


def _only_needed(selected: DataFrame, needed: dict[tuple[str, str], set[str] | None]) -> DataFrame:
    label = "concat_ws('/', app, rule)"
    labels = {f"{app}/{rule}": fields for (app, rule), fields in needed.items()}
    hosts, cases = [], []
    for name, fields in labels.items():
        if fields is None or "host" in fields:
            hosts.append(sql_text(name))
        if fields is not None:
            kept = ", ".join(sql_text(f) for f in sorted(fields - {"host"})) or "NULL"
            cases.append(f"WHEN {sql_text(name)} THEN map_filter(fields, (k, v) -> k IN ({kept}))")
    host = f"CASE WHEN {label} IN ({', '.join(hosts) or 'NULL'}) THEN host END"
    fields = f"CASE {label} {' '.join(cases)} ELSE fields END" if cases else "fields"
    wanted = ", ".join(sql_text(n) for n in labels) or "NULL"
    weight = ["weight"] if "weight" in selected.columns else []
    return selected.filter(f"{label} IN ({wanted})").selectExpr(
        "app", "rule", f"{host} AS host", f"{fields} AS fields", *weight
    )


def fields_json(fields: Column | str = "fields") -> Column:
    """The fields that took part, as JSON text with sorted names."""
    col = F.col(fields) if isinstance(fields, str) else fields
    present = F.filter(F.map_entries(col), lambda e: e["value"].isNotNull())
    return F.to_json(F.map_from_entries(F.array_sort(present)))
