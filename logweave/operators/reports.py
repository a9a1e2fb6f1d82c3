"""Totals, top lists and tables over rule counters, and whole reports.

Everything here reads the counter table of ``rule_results``: one row per rule,
host and field values, with the number of events.  Results are long tables with
one row per entry, so no group is ever collected as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.functions.regex import to_java
from logweave.functions.units import scale_unit, split_unit
from logweave.operators.joins import join_checked, stage
from logweave.operators.ordered import number_rows

# Entries of a cell that are written into one row.
CELL_ENTRIES = 1000


@dataclass(frozen=True)
class Where:
    """Condition on a field: the pattern is found in it, or (``negate``) is not."""

    field: str
    pattern: str
    negate: bool = False

    @property
    def column(self) -> Column:
        found = to_java(self.pattern).test(value_of(self.field))
        return ~found if self.negate else found


@dataclass(frozen=True)
class Pick:
    """What one rule gives to a report item.

    ``columns`` are field names or, in double quotes, literal texts.  ``value`` is a
    numeric field; in a top list ``add`` sums it, otherwise its maximum counts.
    """

    rule: str
    columns: tuple[str, ...]
    where: Where | None = None
    value: str | None = None
    add: bool = False
    unit: str = ""

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if not is_literal(c))

    @property
    def condition(self) -> Column:
        ok = F.col("rule") == self.rule
        return ok & self.where.column if self.where else ok


@dataclass(frozen=True)
class Item:
    """A report item: ``function`` is ``total``, ``top`` or ``table``."""

    subreport: str
    title: str
    function: str
    picks: tuple[Pick, ...]
    headers: tuple[str, ...] = ()
    top: int = 0

    def check(self, rules: dict[str, tuple[str, ...]]) -> Item:
        """Raise on an item that cannot be made; ``rules`` maps rules to their groups."""

        def fail(why: str):
            raise ValueError(f"report item {self.title!r}: {why}")

        if not self.subreport or not self.title:
            fail("subreport and title are required")
        if self.function not in ("total", "top", "table"):
            fail(f"unknown function {self.function!r}")
        if self.function == "total" and self.headers:
            fail("a total has no headers")
        if self.function == "top" and self.top < 1:
            fail("a top list needs a positive size")
        if self.function == "top" and len(self.headers) != 1:
            fail("a top list has one header")
        if self.function == "table" and not self.headers:
            fail("a table needs headers")
        for pick in self.picks:
            groups = rules.get(pick.rule)
            if groups is None:
                fail(f"no rule {pick.rule!r}")
            if self.function == "total" and (len(pick.columns) != 1 or pick.fields):
                fail("a total has one quoted description per rule")
            if self.function == "top" and (len(pick.columns) != 1 or not pick.fields):
                fail("a top list has one field per rule")
            if self.function == "table":
                if pick.value:
                    fail("a table has no value field")
                if len(pick.columns) < len(self.headers):
                    fail("more headers than columns")
                if is_literal(pick.columns[0]) or is_literal(pick.columns[-1]):
                    fail("the first and the last column of a table are fields")
            used = [*pick.fields, *([pick.value] if pick.value else [])]
            used += [pick.where.field] if pick.where else []
            if unknown := [f for f in used if f != "host" and f not in groups]:
                fail(f"rule {pick.rule!r} has no group {unknown}")
            if pick.unit:
                split_unit(pick.unit)
            if pick.where:
                to_java(pick.where.pattern)
        return self


def is_literal(column: str) -> bool:
    return column.startswith('"')


def value_of(field: str) -> Column:
    return F.col("host") if field == "host" else F.col("fields")[field]


def _amount(pick: Pick) -> Column:
    if pick.value is None:
        return F.col("events")
    return value_of(pick.value).try_cast("bigint") * F.col("events")


# -- total -------------------------------------------------------------------


def totals(results: DataFrame, picks: Iterable[Pick]) -> DataFrame:
    """``pick_no, total, description``, in one pass; zero totals are left out.

    With a value field the total is the sum of value times events.
    """
    picks = list(picks)
    sums = [
        F.coalesce(F.sum(F.when(p.condition, _amount(p))), F.lit(0)).alias(f"t{i}")
        for i, p in enumerate(picks)
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("pick_no"),
                F.col(f"t{i}").cast("bigint").alias("total"),
                F.lit(p.columns[0].strip('"')).alias("description"),
            )
            for i, p in enumerate(picks)
        ]
    )
    return results.agg(*sums).select(F.inline(rows)).filter("total != 0")


# -- top ---------------------------------------------------------------------


def top_values(
    results: DataFrame, picks: Iterable[tuple[int, int, Pick]], lines: DataFrame | None = None
) -> DataFrame:
    """``list_no, pick_no, rank, total, value`` for ``(list_no, size, pick)`` triples.

    The ``size`` highest distinct totals of every pick; equal totals share a rank
    and each value has its own row.  With a value field that is not added up, the
    largest counter rows count instead, and a value can appear more than once; they
    are taken from ``lines`` with ``rule, host, fields``, if given.
    """
    picks = list(picks)
    parts = []
    summed = [(n, i, size, p) for i, (n, size, p) in enumerate(picks) if p.value is None or p.add]
    largest = [(n, i, size, p) for i, (n, size, p) in enumerate(picks) if p.value and not p.add]
    if summed:
        parts.append(_top_summed(results, summed))
    if largest:
        parts.append(_top_largest(results if lines is None else lines, largest))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _exploded(results: DataFrame, picks, amount, whole: Column | None = None) -> DataFrame:
    more = [] if whole is None else [whole.alias("whole")]
    entry = F.array(
        *[
            F.when(
                p.condition & value_of(p.fields[0]).isNotNull(),
                F.struct(
                    F.lit(n).alias("list_no"),
                    F.lit(i).alias("pick_no"),
                    F.lit(size).alias("_size"),
                    value_of(p.fields[0]).alias("value"),
                    amount(p).cast("bigint").alias("total"),
                    *more,
                ),
            )
            for n, i, size, p in picks
        ]
    )
    wanted = results.filter(F.col("rule").isin([p.rule for *_, p in picks]))
    return wanted.select(F.inline(F.array_compact(entry)))


def _top_summed(results: DataFrame, picks) -> DataFrame:
    key = ["list_no", "pick_no", "_size"]
    sums = _exploded(results, picks, _amount).groupBy(*key, "value").agg(F.sum("total").alias("total"))
    sums = sums.filter("total is not null")
    highest = _ranked(sums.select(*key, "total").distinct(), key, ["total"], picks)
    # at most `size` totals per pick are left
    bound = sum(size for _, _, size, _ in picks)
    found = join_checked(sums, highest, [*key, "total"], "inner", staged=False, rows=bound)
    return found.select("list_no", "pick_no", "rank", "total", "value")


def _top_largest(results: DataFrame, picks) -> DataFrame:
    """The rows of largest values, each counter key once.

    First the values alone: of those each task keeps the largest distinct ones, and the
    last of a list is a value that no row of the list is below.  Then only the rows
    from there on are told apart by their keys.
    """
    key = ["list_no", "pick_no", "_size"]
    # the counter key of a row: a row of ``results`` may be a line, of which a key has many
    whole = F.struct("rule", "host", F.array_sort(F.map_entries("fields")))
    rows = _exploded(results, picks, lambda p: value_of(p.value).try_cast("bigint"), whole).filter("total is not null")
    biggest = max(size for _, _, size, _ in picks)
    if biggest <= 1000:
        by = W.partitionBy(*key).orderBy(F.col("total").desc())
        values = rows.select(*key, "total").distinct().withColumn("_rank", F.dense_rank().over(by)).filter(F.col("_rank") <= biggest)
        # one row per pick
        least = values.filter("_rank <= _size").groupBy("pick_no").agg(F.min("total").alias("_least"))
        rows = rows.join(F.broadcast(least), "pick_no").filter("total >= _least")
    ranked = _ranked(rows.select(*key, "value", "total", "whole").distinct(), key, ["total", "value"], picks)
    return ranked.select("list_no", "pick_no", "rank", "total", "value")


def _ranked(rows: DataFrame, key: list[str], falling: list[str], picks) -> DataFrame:
    """The first ``_size`` rows of a key by falling columns, with their ``rank``.

    Small lists are cut in each task before the shuffle.  For long ones the chunks
    of an exact numbering stand in for one sort per list.
    """
    biggest = max(size for _, _, size, _ in picks)
    by = W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in falling])
    if biggest > 1000:
        # rows of a list in rising order, counted from its end
        rows = number_rows(rows, key, falling, "_up")
        counts = rows.groupBy(*key).agg(F.max("_up").alias("_all"))
        rows = join_checked(rows, counts, key, "inner", staged=False, rows=len(picks))
        rows = rows.withColumn("rank", (F.col("_all") - F.col("_up") + 1).cast("int")).drop("_up", "_all")
    else:
        rows = rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= biggest)
    return rows.filter("rank <= _size")


# -- table -------------------------------------------------------------------


def table_entries(results: DataFrame, items: Iterable[tuple[int, Item]]) -> DataFrame:
    """``list_no, pick_no, cols, entry, events`` for ``(list_no, item)`` pairs.

    ``cols`` holds all columns but the last; ``entry`` holds the fields of the last
    one, which takes those beyond the headers too.
    """
    entries, rules = [], set()
    for n, item in items:
        for i, pick in enumerate(item.picks):
            head = pick.columns[: len(item.headers) - 1]
            tail = pick.columns[len(item.headers) - 1 :]
            cell = lambda c: F.lit(c.strip('"')) if is_literal(c) else F.coalesce(value_of(c), F.lit(""))
            rules.add(pick.rule)
            entries.append(
                F.when(
                    pick.condition,
                    F.struct(
                        F.lit(n).alias("list_no"),
                        F.lit(i).alias("pick_no"),
                        F.array(*[cell(c) for c in head]).cast("array<string>").alias("cols"),
                        F.array(*[cell(c) for c in tail]).cast("array<string>").alias("entry"),
                        F.col("events"),
                    ),
                )
            )
    wanted = results.filter(F.col("rule").isin(sorted(rules)))
    rows = wanted.select(F.inline(F.array_compact(F.array(*entries))))
    return rows.groupBy("list_no", "pick_no", "cols", "entry").agg(F.sum("events").alias("events"))


def counted_cells(
    entries: DataFrame,
    keys: list[str],
    limit: int = 10,
    sep: str = "::",
    per_row: int | None = None,
    bound: int | None = None,
) -> DataFrame:
    """Write the entries of a key as one text: ``a::b(3), c::d(1) [2 more skipped]``.

    Entries come by falling count, then by name.  The first ``limit`` are shown,
    and beyond them all that happened more than once; the rest is counted.  A
    text of more than ``per_row`` entries goes on in further rows (``part``).
    ``bound`` is a known limit of the number of entries, if there is one.
    """
    per_row = per_row or CELL_ENTRIES
    key = W.partitionBy(*keys).orderBy(F.col("events").desc(), F.col("entry"))
    # the first `limit` per key are cut in each task before the shuffle
    first = entries.withColumn("_rn", F.row_number().over(key)).filter(F.col("_rn") <= limit)
    shown = (
        entries.filter("events > 1")
        .unionByName(first.filter("events <= 1").drop("_rn"))
        .withColumn("_down", -F.col("events"))
    )
    shown = number_rows(shown, keys, ["_down", "entry"], "_no", bound=bound)
    counts = (
        entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
        .join(shown.groupBy(*keys).agg(F.max("_no").alias("_shown")), keys)
    )
    text = F.concat(F.array_join("entry", sep), F.lit("("), F.col("events"), F.lit(")"))
    parts = (
        shown.groupBy(*keys, F.floor((F.col("_no") - 1) / per_row).alias("part"))
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_no", text.alias("t")))), lambda e: e["t"]
                ),
                ", ",
            ).alias("cell")
        )
    )
    skipped = F.col("_all") - F.col("_shown")
    last = F.floor((F.col("_shown") - 1) / per_row) == F.col("part")
    note = F.when(last & (skipped > 0), F.concat(F.lit(" ["), skipped, F.lit(" more skipped]")))
    return (
        parts.join(counts, keys)
        .withColumn("cell", F.concat("cell", F.coalesce(note, F.lit(""))))
        .drop("_all", "_shown")
    )


def whole_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The cells of ``counted_cells`` with one row per key: the parts in order, as one text.

    A text is one value, so all shown entries of a key must fit a row here.
    """
    parts = F.array_sort(F.collect_list(F.struct("part", "cell")))
    return cells.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["cell"]), ", ").alias("cell"))


# -- reports -----------------------------------------------------------------


@dataclass(frozen=True)
class Section:
    """A titled part of a report; items name it as their ``subreport``."""

    name: str
    title: str


@dataclass(frozen=True)
class _Placed:
    no: int
    section: Section
    app: str
    item: Item


def _place_items(apps, sections: Iterable[Section], active: dict[str, set[str]]) -> list[_Placed]:
    """Items in report order: sections as given, apps by (priority, name).

    An item with a rule that is not active is left out.  Tables of one section with
    equal title and headers get the same number, which merges them.
    """
    placed, tables, no = [], {}, 0
    for section in sections:
        for app in sorted(apps, key=lambda a: (a.priority, a.name)):
            for item in app.items:
                if item.subreport != section.name:
                    continue
                if not all(p.rule in active[app.name] for p in item.picks):
                    continue
                item.check({r.name: r.group_names for r in app.rules})
                same = (section.name, item.title, item.headers)
                if item.function == "table" and same in tables:
                    placed.append(_Placed(tables[same], section, app.name, item))
                    continue
                no += 1
                if item.function == "table":
                    tables[same] = no
                placed.append(_Placed(no, section, app.name, item))
    return placed


def needed_fields(
    apps, sections: Iterable[Section], active: dict[str, set[str]] | None = None, largest: bool = True
) -> dict[tuple[str, str], set[str] | None]:
    """What a report asks of ``rule_results``: rules, and the fields of each.

    A list of largest values shows single counters, so it needs all fields; leave it out (``largest``) if it is
    made from the lines themselves (``largest_rules``).
    """
    apps = list(apps)
    needed: dict[tuple[str, str], set[str] | None] = {}
    for entry, pick in _picks(_place_items(apps, sections, active or _all_rules(apps))):
        key = (entry.app, pick.rule)
        used = {*pick.fields, *([pick.value] if pick.value else [])}
        used |= {pick.where.field} if pick.where else set()
        if _is_largest(entry.item, pick):
            if largest:
                needed[key] = None
        elif needed.get(key, used) is not None:
            needed[key] = needed.get(key, set()) | used
    return needed


def largest_rules(
    apps, sections: Iterable[Section], active: dict[str, set[str]] | None = None
) -> dict[tuple[str, str], None]:
    """The rules of lists of largest values, whose lines are told apart by all fields."""
    apps = list(apps)
    placed = _place_items(apps, sections, active or _all_rules(apps))
    return {(entry.app, pick.rule): None for entry, pick in _picks(placed) if _is_largest(entry.item, pick)}


def _picks(placed: list[_Placed]) -> list[tuple[_Placed, Pick]]:
    return [(entry, pick) for entry in placed for pick in entry.item.picks]


def _is_largest(item: Item, pick: Pick) -> bool:
    return item.function == "top" and pick.value is not None and not pick.add


def _all_rules(apps) -> dict[str, set[str]]:
    return {a.name: {r.name for r in a.rules} for a in apps}


def report(
    results: DataFrame,
    apps,
    sections: Iterable[Section],
    limit: int = 5,
    active: dict[str, set[str]] | None = None,
    lines: DataFrame | None = None,
) -> DataFrame:
    """All rows of a report: ``item_no, subreport, title, app, row_no, part, cols``.

    A table cell of more than ``CELL_ENTRIES`` entries goes on in further rows, which
    follow each other and are told apart by ``part``; other rows have part 0.

    ``results`` is the output of ``rule_results``.  The counters are staged once and
    read three times, by the totals, the top lists and the tables.  Lists of largest
    values are made from ``lines`` with ``app, rule, host, fields``, if given; the
    counters then need no more than the other items ask for.  Items without rows do
    not appear.
    """
    apps = list(apps)
    active = active or _all_rules(apps)
    placed = _place_items(apps, sections, active)
    results = stage(results)
    rows = []
    flat = _picks(placed)
    # every pick makes at most one row of a counter, or as many as the list of largest values has
    bound = results.count() * len(flat) + sum(e.item.top for e, p in flat if _is_largest(e.item, p))
    if totals_ := [(i, e, p) for i, (e, p) in enumerate(flat) if e.item.function == "total"]:
        rows.append(_total_rows(results, totals_))
    if tops := [(i, e, p) for i, (e, p) in enumerate(flat) if e.item.function == "top"]:
        rows.append(_top_rows(results, tops, lines))
    if any(e.item.function == "table" for e in placed):
        rows.append(_table_rows(results, [e for e in placed if e.item.function == "table"], limit, bound))
    if not rows:
        raise ValueError("no report item can be made from the given apps")
    out = rows[0]
    for part in rows[1:]:
        out = out.unionByName(part)
    out = number_rows(out, ["item_no"], ["_order", "_key", "part"], "row_no", bound=bound)
    info = _item_info(results.sparkSession, placed)
    return out.join(F.broadcast(info), "item_no").select(
        "item_no", "subreport", "title", "app", "row_no", "part", "cols"
    )


def _item_info(spark, placed: list[_Placed]) -> DataFrame:
    """One row per item: a table as long as the report specification."""
    seen = {}
    for e in placed:
        seen.setdefault(e.no, (e.no, e.section.title, e.item.title, e.app))
    return spark.createDataFrame(
        list(seen.values()), "item_no int, subreport string, title string, app string"
    )


def _of_app(results: DataFrame, entries) -> DataFrame:
    return results.filter(F.col("app").isin(sorted({e.app for _, e, _ in entries})))


def _scoped(entry: _Placed, pick: Pick) -> Pick:
    """The pick, with its rule qualified by the app (rules of two apps may share a name)."""
    return Pick(f"{entry.app}/{pick.rule}", pick.columns, pick.where, pick.value, pick.add, pick.unit)


def _qualified(results: DataFrame) -> DataFrame:
    return results.withColumn("rule", F.concat_ws("/", "app", "rule"))


def _per_pick(entries, value) -> Column:
    """A value per pick number, as a lookup in a literal array."""
    size = max(i for i, _, _ in entries) + 1
    filled = dict.fromkeys(range(size))
    filled |= {i: value(e, p) for i, e, p in entries}
    return F.array(*[F.lit(filled[i]) for i in range(size)])[F.col("pick_no")]


def _with_unit(total: Column, entries) -> Column:
    units = {}
    for i, _, p in entries:
        units.setdefault(p.unit, []).append(i)
    text = total.cast("string")
    for unit, numbers in units.items():
        if unit:
            value, label = scale_unit(total, unit, "T")
            text = F.when(
                F.col("pick_no").isin(numbers), F.concat_ws(" ", value.cast("string"), label)
            ).otherwise(text)
    return text


def _total_rows(results: DataFrame, entries) -> DataFrame:
    found = totals(_qualified(results), [_scoped(e, p) for _, e, p in entries])
    entries = [(i, e, p) for i, (_, e, p) in enumerate(entries)]
    cols = F.array(_with_unit(F.col("total"), entries), F.col("description"))
    return found.select(
        _per_pick(entries, lambda e, p: e.no).cast("int").alias("item_no"),
        F.col("pick_no").cast("bigint").alias("_order"),
        cols.alias("_key"),
        F.lit(0).cast("bigint").alias("part"),
        cols.alias("cols"),
    )


def _top_rows(results: DataFrame, entries, lines: DataFrame | None = None) -> DataFrame:
    triples = [(e.no, e.item.top, _scoped(e, p)) for _, e, p in entries]
    found = top_values(_qualified(results), triples, None if lines is None else _qualified(lines))
    entries = [(i, e, p) for i, (_, e, p) in enumerate(entries)]
    cols = F.array(_with_unit(F.col("total"), entries), F.col("value"))
    return found.select(
        F.col("list_no").cast("int").alias("item_no"),
        (-F.col("total")).alias("_order"),
        cols.alias("_key"),
        F.lit(0).cast("bigint").alias("part"),
        cols.alias("cols"),
    )


def _table_rows(results: DataFrame, placed: list[_Placed], limit: int, bound: int) -> DataFrame:
    items = []
    for position, e in enumerate(placed):
        picks = tuple(_scoped(e, p) for p in e.item.picks)
        items.append((position, Item(e.item.subreport, e.item.title, "table", picks, e.item.headers)))
    keys = ["list_no", "pick_no", "cols"]
    cells = counted_cells(table_entries(_qualified(results), items), keys, limit, bound=bound)
    number = F.array(*[F.lit(e.no) for e in placed])[F.col("list_no")]
    return cells.select(
        number.cast("int").alias("item_no"),
        F.lit(0).cast("bigint").alias("_order"),
        F.col("cols").alias("_key"),
        F.col("part").cast("bigint").alias("part"),
        F.concat("cols", F.array("cell")).alias("cols"),
    )


def item_headers(item: Item) -> list[str]:
    """Header row of an item in a table file."""
    if item.function == "top":
        return ["Value", *item.headers]
    return list(item.headers) if item.function == "table" else ["Value", "Description"]


def report_header(
    spark,
    stats: DataFrame,
    counters: DataFrame,
    title: str = "",
    patterns: Iterable[str] = (),
    filters: Iterable[dict[str, str]] = (),
    hosts: Iterable[str] = (),
) -> DataFrame:
    """One row with what the report was made from, next to the run statistics.

    ``counters`` has one row per application, a number fixed by the rule packs.
    """
    groups = [" AND ".join(f"{k}={v!r}" for k, v in g.items()) for g in filters]
    apps = counters.filter("matches > 0").agg(
        F.array_join(
            F.array_sort(F.collect_list(F.concat("app", F.lit("("), "matches", F.lit(")")))), ", "
        ).alias("apps")
    )
    one = F.lit(1)
    both = stats.withColumn("_one", one).join(F.broadcast(apps.withColumn("_one", one)), "_one")
    return both.select(
        F.lit(title).alias("title"),
        F.lit(", ".join(repr(p) for p in patterns)).alias("patterns"),
        F.lit(" OR ".join(f"({g})" for g in groups)).alias("filters"),
        F.lit(", ".join(hosts)).alias("hosts"),
        "apps",
        *[c for c in stats.columns],
    )
