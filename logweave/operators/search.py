"""Pattern search over raw lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.globs import any_of
from logweave.functions.regex import JavaRegex, to_java


@dataclass(frozen=True)
class Patterns:
    """A list of Python patterns; a line is hit when any of them is found in it.

    No pattern, or an empty one, hits every line.
    """

    patterns: tuple[str, ...] = ()
    ignore_case: bool = False
    word: bool = False
    invert: bool = False

    @classmethod
    def of(cls, *patterns: str, **options) -> Patterns:
        return cls(tuple(dict.fromkeys(patterns)), **options)

    @property
    def regexes(self) -> list[JavaRegex]:
        if "" in self.patterns:
            return []
        shape = r"\b(?:{})\b" if self.word else "{}"
        return [to_java(shape.format(p), self.ignore_case) for p in self.patterns]

    def selects(self, col: Column | str = "raw") -> Column:
        col = F.col(col) if isinstance(col, str) else col
        regexes = self.regexes
        if not regexes:
            return F.lit(not self.invert)
        found = any_of([r.test(col) for r in regexes])
        return ~found if self.invert else found

    def matching_part(self, col: Column | str = "raw") -> Column:
        """First match of the first pattern that hits; the whole line without patterns."""
        col = F.col(col) if isinstance(col, str) else col
        regexes = self.regexes
        if not regexes:
            return col
        return F.coalesce(*[F.regexp_substr(col, F.lit(r.pattern)) for r in regexes])

    def all_parts(self, col: Column | str = "raw") -> Column:
        """Every match of the first pattern that hits, as an array."""
        col = F.col(col) if isinstance(col, str) else col
        choice = F.lit(None)
        for r in reversed(self.regexes):
            found = F.regexp_extract_all(col, F.lit(r.pattern), F.lit(0))
            choice = F.when(r.test(col), found).otherwise(choice)
        return choice

    def highlight(self, opening: str, closing: str, col: Column | str = "raw") -> Column:
        """Wrap every match of the first pattern that hits in two markers."""
        col = F.col(col) if isinstance(col, str) else col
        out = col
        mark = (_literal(opening) + "$0" + _literal(closing)) if self.patterns else ""
        for r in reversed(self.regexes):
            marked = F.regexp_replace(col, F.lit(r.pattern), F.lit(mark))
            out = F.when(r.test(col), marked).otherwise(out)
        return out


def _literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def read_patterns(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Patterns of pattern files, one per line, in the given order without duplicates.

    A pattern list is part of the query, like the rule packs, so it is read on the
    driver; ``patternindex`` takes lists of any size as tables.  A blank line is an empty pattern, which hits every line.
    """
    found: dict[str, None] = {}
    for path in [paths] if isinstance(paths, str) else paths:
        lines = spark.read.option("lineSep", "\n").text(path)
        ordered = lines.select("value", F.monotonically_increasing_id().alias("place")).orderBy("place")
        found |= dict.fromkeys(row.value for row in ordered.toLocalIterator())
    return list(found)


def select_lines(lines: DataFrame, patterns) -> DataFrame:
    """The lines that ``patterns`` hit: a list, or a table of them (``PatternTable``)."""
    return lines.filter(patterns.selects()) if isinstance(patterns, Patterns) else patterns.select(lines)
