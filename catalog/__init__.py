"""Registered queries over the driver's tables, each with the SQL it must agree with."""

from __future__ import annotations

from catalog import inputs, mapping, output, parsing, reports, rules, scope, search  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
