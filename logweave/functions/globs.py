"""Shell globs as anchored Java regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_to_java(glob: str) -> str:
    """Whole-name pattern for ``*``, ``?``, ``[abc]`` and ``[!abc]``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            inside = glob[i + 1 : close]
            negate = "^" if inside[0] == "!" else ""
            text = inside[1:] if negate else inside
            safe = "".join(c if c.isalnum() or c == "-" else "\\" + c for c in text)
            out.append(f"[{negate}{safe}]")
            i = close
        else:
            out.append(ch if ch.isalnum() else "\\" + ch)
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def any_of(conditions: list[Column]) -> Column:
    """Whether one of the conditions holds; a balanced tree, so that thousands are no deep expression."""
    if not conditions:
        return F.lit(False)
    while len(conditions) > 1:
        pairs = zip(conditions[::2], conditions[1::2], strict=False)
        conditions = [a | b for a, b in pairs] + conditions[len(conditions) & ~1 :]
    return conditions[0]


def matches_any(col: Column, globs: list[str]) -> Column:
    return any_of([col.rlike(glob_to_java(g)) for g in globs])
