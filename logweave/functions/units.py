"""Scaling of numbers with a measure unit, as a column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted units and prefixes.
UNITS = ("", "B", "Bytes", "Byte", "B/s", "bps", "bit/s", "b/s", "b", "bits")
STEPS = ("", "K", "M", "G", "T", "P", "E", "Z", "Y")


def split_unit(unit: str) -> tuple[str, str]:
    """``'KiB'`` -> ``('Ki', 'B')``."""
    match = re.fullmatch(r"(k|[KMGTPEZY]i?|)(.*)", unit)
    if match[2] not in UNITS:
        raise ValueError(f"unknown measure unit {unit!r}")
    return match[1], match[2]


def scale_unit(value: Column, unit: str = "", prefix: str = "T") -> tuple[Column, Column]:
    """Value and unit text after moving towards ``prefix``.

    Upwards, one step divides by the base and rounds half to even, as long as the
    value is at least ten times the base.  Downwards it multiplies.  The base is
    1000, or 1024 with a binary prefix such as ``Ki``.
    """
    if not unit:
        return value, F.lit("")
    own, unit_name = split_unit(unit)
    if not re.fullmatch(r"k|[KMGTPEZY]i?|", prefix):
        raise ValueError(f"unknown metric prefix {prefix!r}")
    if own and prefix:
        prefix = prefix[0] + ("i" if own.endswith("i") else "")
    binary = "i" if "i" in own + prefix else ""
    base = 1024 if binary else 1000
    here = STEPS.index(own[:1].upper())
    there = STEPS.index(prefix[:1].upper())
    if here > there:
        return value * F.lit(base ** (here - there)), F.lit(prefix + unit_name)
    label = F.lit(own + unit_name)
    moving = F.lit(True)
    for step in range(here, there):
        moving = moving & (value >= base * 10)
        up = STEPS[step + 1] + binary if step or binary else "k"
        label = F.when(moving, F.lit(up + unit_name)).otherwise(label)
        scaled = F.bround(value.cast("double") / base, 0).cast("bigint")
        value = F.when(moving, scaled).otherwise(value)
    return value, label
