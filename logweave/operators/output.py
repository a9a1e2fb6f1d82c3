"""What to do with selected lines: counts, limits, context, threads, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logweave.operators.joins import join_checked, semi_join
from logweave.operators.ordered import chunk_of, first_rows, with_distance

THREAD = ["file", "app", "thread"]


def _weight(df: DataFrame) -> Column:
    return F.col("weight") if "weight" in df.columns else F.lit(1)


def count_per_file(lines: DataFrame, selected: Column) -> DataFrame:
    """Matches per file, files without any included; repetitions count."""
    hit = F.when(selected, _weight(lines)).otherwise(0)
    return lines.groupBy("file").agg(F.sum(hit).cast("bigint").alias("matches"))


def files_with_match(lines: DataFrame, selected: Column) -> DataFrame:
    return lines.filter(selected).select("file").distinct()


def files_without_match(lines: DataFrame, selected: Column) -> DataFrame:
    """Decided from one flag per file, so the lines are read once and never joined."""
    hit = F.bool_or(F.coalesce(selected, F.lit(False)))
    return lines.groupBy("file").agg(hit.alias("hit")).filter(~F.col("hit")).select("file")


def max_count(selected: DataFrame, n: int) -> DataFrame:
    """The first ``n`` selected lines of every file."""
    if n < 1:
        raise ValueError("the limit must be a positive number")
    return first_rows(selected, ["file"], n)


def first_selected(lines: DataFrame, selected: str, n: int) -> DataFrame:
    """Lines of which only the first ``n`` selected ones of each file stay selected."""
    first = max_count(lines.filter(selected).select("file", "line_no"), n)
    last = first.groupBy("file").agg(F.max("line_no").alias("_last"))
    found = join_checked(lines, last, ["file"], "left")
    kept = F.coalesce(F.expr(selected) & (F.col("line_no") <= F.col("_last")), F.lit(False))
    return found.withColumn(selected, kept).drop("_last")


def until_limit(lines: DataFrame, selected: DataFrame, n: int) -> DataFrame:
    """Lines of each file up to its ``n``-th selected one, where reading it ends; all if it has fewer."""
    first = max_count(selected.select("file", "line_no"), n).groupBy("file")
    ends = first.agg(F.count(F.lit(1)).alias("_n"), F.max("line_no").alias("_last")).filter(F.col("_n") == n)
    found = join_checked(lines, ends.select("file", "_last"), ["file"], "left")
    return found.filter(F.col("_last").isNull() | (F.col("line_no") <= F.col("_last"))).drop("_last")


def any_match(lines: DataFrame, selected: Column) -> DataFrame:
    """One row that tells whether a line is selected."""
    return lines.agg(F.coalesce(F.bool_or(selected), F.lit(False)).alias("any_match"))


def exists(lines: DataFrame, selected: Column) -> bool:
    """Whether a line is selected; stops at the first one."""
    return not lines.filter(selected).limit(1).isEmpty()


def context(
    lines: DataFrame,
    selected: Column,
    before: int = 0,
    after: int = 0,
    around: int = 0,
) -> DataFrame:
    """Selected lines and their neighbours in the file, told apart by ``kind``.

    ``lines`` are the lines in scope; distances count these.  ``around`` is the
    least number on both sides.
    """
    flagged = lines.withColumn("_selected", F.coalesce(selected, F.lit(False)))
    near = with_distance(
        flagged, ["file"], "_selected", max(before, around), max(after, around)
    )
    return _kind(near)


def _kind(near: DataFrame) -> DataFrame:
    kind = F.when(F.col("_selected"), "match").otherwise("context")
    return near.withColumn("kind", kind).drop("_selected")


def context_groups(shown: DataFrame) -> DataFrame:
    """Number the stretches of adjacent lines of a file, and mark where a separator goes.

    A separator comes before every stretch of a file but its first.
    """
    chunk = ["file", "_chunk"]
    here = W.partitionBy(*chunk).orderBy("line_no")
    lines = shown.withColumn("_chunk", chunk_of())
    gap = F.col("line_no") - F.lag("line_no").over(here) > 1
    gaps = lines.select(*chunk, "line_no", F.coalesce(gap, F.lit(False)).alias("_gap"))
    table = gaps.groupBy(*chunk).agg(
        F.min("line_no").alias("_low"),
        F.max("line_no").alias("_high"),
        F.count_if("_gap").alias("_gaps"),
    )
    by_chunk = W.partitionBy("file").orderBy("_chunk")
    table = table.withColumn("_before", F.lag("_high").over(by_chunk))
    opens = F.col("_before").isNull() | (F.col("_low") - F.col("_before") > 1)
    earlier = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    starts = F.sum(F.col("_gaps") + opens.cast("int")).over(earlier)
    table = table.select(*chunk, "_before", F.coalesce(starts, F.lit(0)).alias("_starts"))
    out = lines.join(table, chunk)
    out = out.withColumn("_prev", F.coalesce(F.lag("line_no").over(here), F.col("_before")))
    is_start = F.col("_prev").isNull() | (F.col("line_no") - F.col("_prev") > 1)
    out = out.withColumn("_start", is_start.cast("int"))
    running = F.sum("_start").over(here.rowsBetween(W.unboundedPreceding, 0))
    return (
        out.withColumn("group_no", (F.col("_starts") + running).cast("bigint"))
        .withColumn("separator", (F.col("_start") == 1) & F.col("_prev").isNotNull())
        .drop("_chunk", "_before", "_starts", "_prev", "_start")
    )


def thread_context(parsed: DataFrame, selected: Column, before: int = 0, after: int = 0) -> DataFrame:
    """Selected lines and their neighbours in the thread (same file, app and thread).

    A line without thread stays only if it is selected itself.
    """
    flagged = parsed.withColumn("_selected", F.coalesce(selected, F.lit(False)))
    threaded = flagged.filter(F.col("thread").isNotNull() & F.col("app").isNotNull())
    alone = flagged.filter("(thread is null or app is null) and _selected")
    # only threads with a selected line go on
    threads = threaded.filter("_selected").select(*THREAD).distinct()
    threaded = semi_join(threaded, threads, THREAD)
    near = with_distance(threaded, THREAD, "_selected", before, after)
    return _kind(near.unionByName(alone))


def whole_threads(parsed: DataFrame, selected: Column) -> DataFrame:
    """All lines of the threads that hold a selected line, and selected lines without thread."""
    flagged = parsed.withColumn("_selected", F.coalesce(selected, F.lit(False)))
    alone = flagged.filter("(thread is null or app is null) and _selected").drop("_selected")
    threads = flagged.filter("_selected").select(*THREAD).dropna().distinct()
    return semi_join(parsed, threads, THREAD).unionByName(alone)


def run_stats(lines: DataFrame, selected: Column) -> DataFrame:
    """Files, lines, matches, lines of unknown format, first and last selected event.

    Counted per file first, so that a count of distinct files needs no shuffle of lines.
    """
    unknown = F.col("format").isNull() if "format" in lines.columns else F.lit(False)
    hit = F.coalesce(selected, F.lit(False))
    per_file = lines.groupBy("file").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.when(hit, _weight(lines)).otherwise(0)).alias("matches"),
        F.count_if(unknown).alias("unknown"),
        F.min(F.when(hit, F.col("event_ts"))).alias("first_event"),
        F.max(F.when(hit, F.col("event_ts"))).alias("last_event"),
    )
    return per_file.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("matches"), F.lit(0)).cast("bigint").alias("matches"),
        F.coalesce(F.sum("unknown"), F.lit(0)).alias("unknown"),
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
    )


def format_lines(
    df: DataFrame, with_filename: bool = True, line_number: bool = False, text: str = "raw"
) -> DataFrame:
    """Lines as printed: optional file and number, then ``:`` for matches, ``-`` for context."""
    mark = F.lit(":")
    if "kind" in df.columns:
        mark = F.when(F.col("kind") == "context", "-").otherwise(":")
    parts = []
    if with_filename:
        parts += [F.col("file"), mark]
    if line_number:
        parts += [F.col("line_no").cast("string"), mark]
    return df.withColumn("text", F.concat(*parts, F.col(text)))


def sorted_lines(df: DataFrame) -> DataFrame:
    """File and line order, for output."""
    return df.orderBy("file", "line_no")
