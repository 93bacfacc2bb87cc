"""Structured Streaming over the same logic as the batch: new files are appended, state is what they compact to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def replay(
    spark: SparkSession, path: str, schema: T.StructType, apply: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files: int = 1
) -> None:
    """Runs all files of a folder through ``apply``, some files a batch, and appends what comes out.

    Each batch is written once to a folder of its own number, so a batch that is run
    again after a failure replaces what it wrote.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = apply(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def first_seen(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Keeps the first row of each key; with an event time, state older than the delay is let go."""
    if event_time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def slot_counts(stream: DataFrame, ts: str, minutes: int, delay: str = "1 day") -> DataFrame:
    """Rows of each fixed slot."""
    windows = stream.withWatermark(ts, delay).groupBy(F.window(ts, f"{minutes} minutes"))
    return windows.agg(F.count("*").alias("n")).select(F.col("window.start").alias("slot"), "n")


def work(tasks: dict[str, Callable[[], None]], strict: bool = False) -> dict[str, str]:
    """Runs the tasks of one tick in their order; a failed one is reported and, unless strict, does not stop the next."""
    out = {}
    for name, task in tasks.items():
        try:
            task()
            out[name] = "ok"
        except Exception as failure:
            if strict:
                raise
            out[name] = f"error: {failure}"
    return out
