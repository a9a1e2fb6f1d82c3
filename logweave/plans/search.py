"""A whole run: from lines to selected lines, counts, context and reports."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.regex import compute_once
from logweave.functions.timespec import Period, TimeRange
from logweave.operators import output, reports
from logweave.operators.headers import (
    BUILT_IN,
    HEADER_COLUMNS,
    HeaderFormat,
    file_counts,
    known_lines,
    parse_headers,
    unknown_files,
)
from logweave.operators.joins import join_checked, stage
from logweave.operators.mapping import map_fields, rewrite_raw, withhold_named
from logweave.operators.patternindex import PatternTable
from logweave.operators.rules import (
    App,
    app_counters,
    apply_rules,
    bind_rules,
    choose_apps,
    extra_tags,
    fold_repeats,
    lines_of_rules,
    route,
    rule_results,
    select_mode,
)
from logweave.operators.scope import host_matches, in_period, in_time_range, on_hosts, period_holds, until_newer
from logweave.operators.search import Patterns
from logweave.packs import default_sections, shipped
from logweave.streaming.stream import require_batch


@dataclass(frozen=True)
class LogSearch:
    """What to look for in log lines.

    ``patterns`` are a list, or a table if they are many.
    ``mode`` is ``ruled`` (a rule must match), ``unparsed`` (no rule may match) or
    ``unruled`` (only the tag must belong to an app).  ``filters`` are groups of
    field patterns: all of a group, any of the groups.  With ``repeats`` the lines
    need a ``line_no``; a notice of repetition then adds to the line before it.
    ``use_offset`` moves event times to UTC, ``wrap`` lets a time range go over
    midnight.  ``max_count`` limits the selected lines of each file, for all results.

    With ``mask``, ``addresses`` or ``users`` all lines that are given out are mapped,
    neighbours too.  Masked lines that no rule matched have no known values, so their
    text is withheld; so are values that stand as ``user=...`` and the like in what a
    rule took no notice of.  A mode without rules cannot be mapped.
    """

    patterns: Patterns | PatternTable = Patterns()
    period: Period = (None, None)
    time_range: TimeRange | None = None
    hosts: tuple[str, ...] = ()
    apps: tuple[App, ...] = field(default_factory=lambda: tuple(shipped()))
    app_names: tuple[str, ...] = ()
    filters: tuple[dict[str, str], ...] = ()
    mode: str = "ruled"
    threads: bool = False
    formats: tuple[HeaderFormat, ...] = BUILT_IN
    reference: Column | None = None
    use_offset: bool = False
    wrap: bool = False
    repeats: bool = False
    skip_unknown_files: bool = False
    stop_at_newer: bool = False
    max_count: int = 0
    mask: bool = False
    addresses: DataFrame | None = None
    users: DataFrame | None = None

    def but(self, **changes) -> LogSearch:
        return replace(self, **changes)

    def __post_init__(self):
        if self.mapped and self.mode != "ruled":
            raise ValueError("values are mapped by the rules that find them: use mode 'ruled'")

    @property
    def mapped(self) -> bool:
        return self.mask or self.addresses is not None or self.users is not None

    @cached_property
    def active_apps(self) -> list[App]:
        return choose_apps(self.apps, self.app_names)

    @property
    def selected(self) -> Column:
        """Condition for selected lines among those of ``in_scope``."""
        return F.col("selected")

    def parse(self, lines: DataFrame) -> DataFrame:
        """Lines with header columns; unknown lines stay unless the file is skipped."""
        return parse_headers(lines, self.formats, self.use_offset, self.reference)

    def in_scope(self, lines: DataFrame) -> DataFrame:
        """Lines of known format within period, time range and hosts.

        Without line numbers, and in a stream, only row-wise steps are taken.
        """
        parsed = self.parse(lines)
        if self.skip_unknown_files:
            require_batch(lines, "skipping files of unknown format")
            if self.repeats:
                parsed = join_checked(parsed, unknown_files(parsed), ["file"], "left_anti")
            else:
                parsed = known_lines(parsed)
        if self.repeats:
            require_batch(lines, "counting repetitions")
            events = fold_repeats(parsed)
        else:
            events = parsed.filter("format is not null and repeat is null")
        if self.stop_at_newer and self.period[1] is not None:
            require_batch(lines, "stopping at newer lines")
            events = until_newer(events, self.period[1])
        events = in_period(events, self.period)
        if self.time_range is not None:
            events = in_time_range(events, self.time_range, self.wrap)
        return on_hosts(events, list(self.hosts))

    @property
    def by_line(self) -> bool:
        """Whether the lines in scope, and those selected, can be told one by one."""
        ends = self.stop_at_newer and self.period[1] is not None
        return not (self.repeats or ends or self.max_count or isinstance(self.patterns, PatternTable))

    def _all_flagged(self, lines: DataFrame) -> DataFrame:
        """All lines, those out of scope too, with ``selected``: nothing is left out, so counts need one scan.

        For runs that tell lines one by one.
        """
        inside = F.col("format").isNotNull() & F.col("repeat").isNull() & period_holds(self.period)
        if self.time_range is not None:
            given = self.time_range
            parsed = TimeRange.parse(given) if isinstance(given, str) else given
            inside = inside & parsed.contains(F.col("ltime"), self.wrap)
        if self.hosts:
            inside = inside & host_matches(list(self.hosts))
        hit = F.coalesce(inside, F.lit(False)) & self.patterns.selects()
        found = compute_once(self.parse(lines), "hit", hit)
        return self._selected_of(found)

    def _selected_of(self, scope: DataFrame) -> DataFrame:
        """Rules run only on hits: a line without message matches none."""
        if self.mode == "unruled":
            found = route(scope, self.active_apps)
        else:
            hidden = scope.withColumn("_message", F.col("message")).withColumn(
                "message", F.when(F.col("hit"), F.col("message"))
            )
            found = apply_rules(hidden, self.active_apps, self.filters)
            found = found.withColumn("message", F.col("_message")).drop("_message")
        return found.withColumn("selected", F.col("hit") & select_mode(found, self.mode))

    def _flag_hits(self, scope: DataFrame) -> DataFrame:
        if isinstance(self.patterns, PatternTable):
            require_batch(scope, "a table of patterns")
            return self.patterns.flag(scope)
        return compute_once(scope, "hit", self.patterns.selects())

    def hits(self, lines: DataFrame) -> DataFrame:
        """Lines in scope that the patterns hit."""
        scope = self.in_scope(lines)
        if isinstance(self.patterns, PatternTable):
            return self._flag_hits(scope).filter("hit").drop("hit")
        return scope.filter(self.patterns.selects())

    def flagged(self, lines: DataFrame) -> DataFrame:
        """Lines in scope with ``hit`` (by the patterns), ``selected``, ``app`` and the rule columns.

        Rules run only on lines that the patterns hit, unless threads are wanted.
        """
        scope = self._flag_hits(self.in_scope(lines))
        if self.threads and self.mode != "unruled":
            found = apply_rules(scope, self.active_apps, self.filters, threads=True)
            found = found.withColumn("selected", F.col("hit") & select_mode(found, self.mode))
        else:
            found = self._selected_of(scope)
        if self.max_count:
            require_batch(lines, "a limit per file")
            found = output.first_selected(found, "selected", self.max_count)
        return found

    def _shown(self, found: DataFrame) -> DataFrame:
        """Lines as they are given out: mapped if a mapping is asked for."""
        if not self.mapped:
            return found
        if self.mask:
            require_batch(found, "masking")
        found = map_fields(found, self.active_apps, self.mask, self.addresses, self.users)
        found = rewrite_raw(found, self.active_apps, self.formats)
        if not self.mask:
            return found
        hidden = {c: withhold_named(F.col(c)) for c in ("raw", "message") if c in found.columns} | {"host": F.col("host")}
        found = found.withColumns({c: F.when(F.col("matched"), value) for c, value in hidden.items()})
        # a process id may be the thread
        return found.withColumn("procid", F.lit(None).cast("string"))

    def select(self, lines: DataFrame) -> DataFrame:
        """The selected lines, mapped if a mapping is asked for."""
        scope = self.hits(lines)
        if self.mode == "unruled":
            found = route(scope, self.active_apps).filter("app is not null")
        else:
            ruled = apply_rules(scope, self.active_apps, self.filters, self.threads)
            found = ruled.filter(select_mode(ruled, self.mode))
        if self.max_count:
            require_batch(lines, "a limit per file")
            found = output.max_count(found, self.max_count)
        return self._shown(found)

    def context(self, lines: DataFrame, before: int = 0, after: int = 0, around: int = 0) -> DataFrame:
        """Selected lines with neighbours; lines of unknown tag that the patterns hit are no neighbours."""
        require_batch(lines, "context")
        flagged = self.flagged(lines)
        near = flagged.filter(F.col("app").isNotNull() | ~F.col("hit"))
        # neighbours are shown as they are: the parts of their headers are not kept
        parts = [*[c for c in HEADER_COLUMNS if c != "host"], "fields"]
        if not self.mapped:
            return output.context(near.drop(*parts), self.selected, before, after, around)
        shown = output.context(near, self.selected, before, after, around)
        # only what is shown is mapped, so rules run on neighbours here
        shown = stage(shown.drop("app", "rule", "thread", "fields", "matched", "full_match"))
        ruled = apply_rules(shown, self.active_apps, self.filters, threads=True)
        return self._shown(ruled).drop(*parts)

    def threads_of(self, lines: DataFrame, before: int | None = None, after: int | None = None) -> DataFrame:
        """Whole threads with a selected line, or a part of them around it."""
        require_batch(lines, "threads")
        flagged = self.but(threads=True).flagged(lines).filter("matched")
        if before is None and after is None:
            shown = output.whole_threads(flagged, self.selected)
        else:
            shown = output.thread_context(flagged, self.selected, before or 0, after or 0)
        return self._shown(stage(shown) if self.mapped else shown)

    def counts(self, lines: DataFrame) -> DataFrame:
        """Matches per file, files without any included.

        Repetitions count, but not towards a limit of lines.
        """
        if self.by_line and not self.skip_unknown_files:
            return output.count_per_file(self._all_flagged(lines), F.coalesce(self.selected, F.lit(False)))
        found = output.count_per_file(self.flagged(lines), self.selected)
        files = lines.select("file").distinct()
        return files.join(found, "file", "left").select("file", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"))

    def stats(self, lines: DataFrame) -> DataFrame:
        """Run statistics: files and lines read, lines of unknown format, and what was selected.

        Of a file that is skipped for its unknown format one line counts as read.
        """
        selected = F.coalesce(self.selected, F.lit(False))
        if self.by_line:
            found = self._all_flagged(lines)
            counted = file_counts(found, self.skip_unknown_files, *_selected_counts(found, selected))
            # what is selected in a file that is skipped does not count
            kept = lambda c: F.when(~F.coalesce("skipped", F.lit(False)), F.col(c)).alias(c)
            per_file = counted.select("file", "lines", "unknown", *(kept(c) for c in ("matches", "first_event", "last_event")))
        else:
            read = file_counts(self.parse(lines), self.skip_unknown_files)
            flagged = self.flagged(lines).filter("selected")
            matches = flagged.groupBy("file").agg(*_selected_counts(flagged, F.lit(True)))
            per_file = read.join(matches, "file", "left")
        return per_file.agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("lines"),
            F.coalesce(F.sum("matches"), F.lit(0)).cast("bigint").alias("matches"),
            F.coalesce(F.sum("unknown"), F.lit(0)).cast("bigint").alias("unknown"),
            F.min("first_event").alias("first_event"),
            F.max("last_event").alias("last_event"),
        )

    def app_counters(self, lines: DataFrame) -> DataFrame:
        """Per app, events that a rule matched and events that none did, in the lines read before a limit."""
        return app_counters(self._until_limit(apply_rules(self.hits(lines), self.active_apps, self.filters), lines))

    def extra_tags(self, lines: DataFrame) -> DataFrame:
        """Tags of no app, in the lines read before a limit."""
        return extra_tags(self._until_limit(self.hits(lines), lines), self.active_apps)

    def _until_limit(self, found: DataFrame, lines: DataFrame) -> DataFrame:
        if not self.max_count:
            return found
        require_batch(lines, "a limit per file")
        selected = self.but(max_count=0).flagged(lines).filter("selected")
        return output.until_limit(found, selected, self.max_count)

    def results(self, lines: DataFrame) -> DataFrame:
        """Events per rule, host and fields."""
        return rule_results(self.select(lines))

    def report(
        self, lines: DataFrame, sections: Iterable[reports.Section] | None = None, limit: int = 5
    ) -> DataFrame:
        """All report rows of the selected lines."""
        sections = list(default_sections() if sections is None else sections)
        # under filters only rules that use all fields of a group can select
        active = {a.name: {r.name for r in bind_rules(a, self.filters) if r.full} for a in self.active_apps}
        needed = reports.needed_fields(self.active_apps, sections, active, largest=False)
        largest = reports.largest_rules(self.active_apps, sections, active)
        selected, of_largest = self.select(lines), None
        if largest:
            # the rules run once; the counters and the largest values are made from what they found
            selected = stage(lines_of_rules(selected, dict.fromkeys(needed | largest)))
            of_largest = lines_of_rules(selected, largest)
        results = rule_results(selected, needed)
        return reports.report(results, self.active_apps, sections, limit, active, of_largest)


def _selected_counts(found: DataFrame, selected: Column) -> list[Column]:
    """Matches, and the first and last event of those, as aggregates."""
    weight = F.col("weight") if "weight" in found.columns else F.lit(1)
    event = F.when(selected, F.col("event_ts"))
    return [F.sum(F.when(selected, weight)).alias("matches"), F.min(event).alias("first_event"), F.max(event).alias("last_event")]
