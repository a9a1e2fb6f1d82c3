"""Search system logs and report on them with Spark."""

from logweave.functions.timespec import TimeRange, date_period, last_period
from logweave.operators.headers import HeaderFormat
from logweave.operators.patternindex import PatternTable, read_pattern_table
from logweave.operators.reports import Item, Pick, Section, Where
from logweave.operators.rules import App, Rule, parse_filter
from logweave.operators.search import Patterns, read_patterns
from logweave.packs import default_sections, shipped
from logweave.plans.search import LogSearch
from logweave.sources.files import read_apps, read_lines
from logweave.sources.tables import from_table, from_text_column

__all__ = [
    "App", "HeaderFormat", "Item", "LogSearch", "PatternTable", "Patterns", "Pick", "Rule", "Section", "TimeRange",
    "Where", "date_period", "default_sections", "from_table", "from_text_column", "last_period",
    "parse_filter", "read_apps", "read_lines",
    "read_pattern_table", "read_patterns", "shipped",
]
