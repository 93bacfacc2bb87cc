"""Tables written to the folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; one of its own only where no cluster needs to share it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of whole texts that go to a Python worker at once while a table is written here.
BATCH_ROWS = 1000


def lower_batches(spark: SparkSession) -> str:
    """Keeps the session's Arrow batches small in the JVM and in Python; gives the setting that it had."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return before


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes that go to a Python worker at once where whole texts are handed on from stage to stage.
BATCH_BYTES = 1 << 19


def _number_of_bytes(setting: str) -> int:
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", setting.lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def lower_batch_bytes(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches, so that rows of whole texts take no more native memory than narrow ones.

    What the JVM frees of large native blocks it gives back late or not at all, thread by thread.
    """
    if not 0 < _number_of_bytes(spark.conf.get(_BATCH_BYTES)) <= BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession):
    """Small Arrow batches for a while; the session's own setting comes back."""
    before = lower_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def fewer_parts(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints ``df``; a folder of its own is set only where the session has none."""
    shared_folder(df.sparkSession)
    with small_batches(df.sparkSession):
        return df.checkpoint()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession, drop: bool = True):
    """What a query shuffles goes as soon as it is done, not when its plan is collected; the session's own setting comes back."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true" if drop else before)
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Workspace:
    """Compressed tables for the intermediate results of one operator, which it drops itself; ``drop_shuffles``: and shuffles too."""

    def __init__(self, spark: SparkSession, drop_shuffles: bool = False):
        self.spark, self.path, self.number = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", 0
        self.drop_shuffles = drop_shuffles

    def keep(self, df: DataFrame, fewer: bool = False) -> DataFrame:
        """Writes and reads ``df``; ``fewer``: what comes out of a shuffle is far less than went in, and fewer files hold it."""
        self.number += 1
        if fewer:
            df = df.coalesce(fewer_parts(self.spark))
        with small_batches(self.spark), shuffles_dropped(self.spark, self.drop_shuffles):
            df.write.option("compression", "zstd").parquet(f"{self.path}/{self.number}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.number}")
        out.workspace_number = self.number
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            self._delete(f"{self.path}/{table.workspace_number}")

    def tidy(self) -> None:
        """Lets Spark's cleaner see that shuffles of finished steps are no longer in use."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
