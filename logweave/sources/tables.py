"""Any DataFrame as a source of log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.operators.ordered import number_rows


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_table(
    df: DataFrame,
    file: Column | str,
    raw: Column | str,
    mtime: Column | str,
    line_no: Column | str | None = None,
    order: list[Column | str] = (),
    keep: list[str] = (),
) -> DataFrame:
    """Rows as lines: ``file, file_mtime, line_no, raw`` and the columns in ``keep``.

    A column that already counts the lines of a file is used as ``line_no``.
    Otherwise lines are numbered in the given ``order``, which must be total within
    a file; without either, ``line_no`` is left out, which is all that operators
    without a notion of order need.
    """
    columns = [
        _col(file).cast("string").alias("file"),
        _col(mtime).cast("timestamp").alias("file_mtime"),
        _col(raw).alias("raw"),
        *[F.col(k) for k in keep],
    ]
    if line_no is not None:
        return df.select(*columns, _col(line_no).cast("bigint").alias("line_no"))
    if not order:
        return df.select(*columns)
    sort = [_col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(sort))]
    ordered = df.select(*columns, *sort)
    return number_rows(ordered, ["file"], names, staged=False).drop(*names)


def from_text_column(
    df: DataFrame, file: Column | str, text: Column | str, mtime: Column | str, keep: list[str] = ()
) -> DataFrame:
    """One line per line feed of a text column, numbered from 1 within each row."""
    lines = df.select(
        _col(file).cast("string").alias("file"),
        _col(mtime).cast("timestamp").alias("file_mtime"),
        *[F.col(k) for k in keep],
        F.posexplode(F.split(_col(text), "\n", -1)).alias("_pos", "raw"),
    )
    return lines.withColumn("line_no", (F.col("_pos") + 1).cast("bigint")).drop("_pos")
