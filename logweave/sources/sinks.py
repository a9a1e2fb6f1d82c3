"""Writing lines and report tables (K1-K5)."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.joins import path_exists, stage, staged
from logweave.operators.reports import Item, item_headers

#: Takes a result; or a micro-batch with its number and the name of its stream.
Channel = Callable[..., None]


def write_all(df: DataFrame, channels: Iterable[Channel]) -> None:
    """Send one result to several channels; it is computed once, and what that took is deleted then."""
    channels = list(channels)
    if df.isStreaming:
        raise ValueError("use stream_to for streams")
    if len(channels) == 1:
        channels[0](df)
        return
    with staged(df) as table:
        for channel in channels:
            channel(table)


class CommitLog:
    """What a stream has written below a folder, one entry for each batch.

    An entry is opened with the day it belongs to, before anything is written, and
    closed afterwards.  A batch that is sent again is passed over if its entry is
    closed, and replaced on its first day otherwise.  Entries lie in a hidden folder,
    by stream and batch, so streams that share a folder do not meet.
    """

    def __init__(self, spark: SparkSession, path: str, stream: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/_commits/{_as_name(stream)}"

    def _write(self, entry: str, **values: str) -> None:
        kind = ", ".join(f"{k} string" for k in values)
        row = self.spark.createDataFrame([tuple(values.values())], kind).coalesce(1)
        row.write.mode("overwrite").json(f"{self.path}/{entry}")

    def _there(self, entry: str) -> bool:
        return path_exists(self.spark, f"{self.path}/{entry}/_SUCCESS")

    def open(self, batch: int, day: str) -> str | None:
        """The day to write a batch to; None if all of it is written."""
        if self._there(f"batch={batch}/closed"):
            return None
        if not self._there(f"batch={batch}/opened"):
            self._write(f"batch={batch}/opened", day=day)
        return self.spark.read.schema("day string").json(f"{self.path}/batch={batch}/opened").first().day

    def close(self, batch: int, target: str) -> None:
        self._write(f"batch={batch}/closed", target=target)


def _as_name(text: str) -> str:
    """A text as a part of a path; different texts give different parts."""
    return "".join(c if c.isalnum() or c in "-." else f"_{ord(c):x}_" for c in text)


def to_directory(
    path: str, fmt: str = "text", run_date: dt.date | None = None, text: str = "raw", gzip: bool = False
) -> Channel:
    """A channel that writes below ``path/run_date=YYYY-MM-DD``.

    ``fmt`` is ``text`` (the column ``text``), ``json`` or ``parquet``; ``gzip``
    compresses text, which makes it an archive of raw lines.  A micro-batch has a
    folder of its own, ``stream=NAME/batch=N`` of the day it is first sent, and an
    entry in the commit log of the folder.
    """

    def send(df: DataFrame, batch: int | None = None, stream: str = "stream") -> None:
        day = (run_date or dt.date.today()).isoformat()
        if fmt == "text":
            df = df.select(F.col(text).alias("value"))
        if batch is None:
            writer, target = df.withColumn("run_date", F.lit(day)).write.mode("append").partitionBy("run_date"), path
        else:
            log = CommitLog(df.sparkSession, path, stream)
            day = log.open(batch, day)
            if day is None:
                return
            target = f"{path}/run_date={day}/stream={_as_name(stream)}/batch={batch}"
            writer = df.write.mode("overwrite")
        if gzip:
            writer = writer.option("compression", "gzip")
        writer.format(fmt).save(target)
        if batch is not None:
            log.close(batch, target)

    return send


def to_console(n: int = 20) -> Channel:
    """Print the first ``n`` lines."""

    def send(df: DataFrame, batch: int | None = None, stream: str = "stream") -> None:
        df.show(n, truncate=False)

    return send


def iterate(df: DataFrame, column: str = "raw"):
    """Lines one by one on the driver, which holds one partition at a time."""
    for row in df.select(column).toLocalIterator():
        yield row[0]


def write_csv_tables(report: DataFrame, items: dict[int, Item], path: str) -> list[str]:
    """One CSV directory per report item: ``|`` between columns, a header row.

    ``items`` gives the item behind each ``item_no``: as many as the specification
    lists.
    """
    report = stage(report)
    written = []
    for no, item in sorted(items.items()):
        rows = report.filter(F.col("item_no") == no)
        if rows.isEmpty():
            continue
        headers = item_headers(item)
        name = re.sub(r"[^0-9A-Za-z]+", "_", item.title).strip("_").lower()
        target = f"{path.rstrip('/')}/{no:02d}_{name}"
        (
            rows.orderBy("row_no")
            .select(*[F.col("cols")[i].alias(h) for i, h in enumerate(headers)])
            .write.mode("overwrite")
            .csv(target, sep="|", header=True)
        )
        written.append(target)
    return written
