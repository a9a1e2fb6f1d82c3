"""Line streams.

Header parsing, scope filters, pattern search, routing and rules work on a row
at a time, so they apply to a stream unchanged.  What depends on the place of a
line in its file (line numbers, repetitions, context, threads, limits) and tokens
need the whole input and are for batches only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.joins import checkpoint_dir, staged
from logweave.sources.files import file_name


def read_line_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """New files below ``path`` as lines: ``file, file_mtime, raw``."""
    reader = spark.readStream.option("lineSep", "\n")
    for key, value in options.items():
        reader = reader.option(key, value)
    text = F.col("value")
    latin1 = F.decode(text.cast("binary"), "ISO-8859-1")
    return reader.text(path).select(
        file_name(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_modification_time").alias("file_mtime"),
        F.when(F.is_valid_utf8("value"), text).otherwise(latin1).alias("raw"),
    )


def require_batch(df: DataFrame, what: str) -> None:
    if df.isStreaming:
        raise ValueError(f"{what} needs a batch, not a stream")


def stream_to(df: DataFrame, channels: Iterable[Callable[..., None]], name: str, **trigger):
    """Send every micro-batch, with its number and the stream's name, to all channels.

    Progress is kept in the shared folder, and so is a batch for several channels while
    it is sent.  A batch may be sent again after a failure; channels that write know by
    their log what they have of it.  Streams of one run need names of their own.
    """
    channels = list(channels)

    def send(batch: DataFrame, number: int) -> None:
        if len(channels) == 1:
            channels[0](batch, number, name)
            return
        with staged(batch) as table:
            for channel in channels:
                channel(table, number, name)

    return (
        df.writeStream.foreachBatch(send)
        .option("checkpointLocation", f"{checkpoint_dir(df.sparkSession)}/streams/{name}")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
