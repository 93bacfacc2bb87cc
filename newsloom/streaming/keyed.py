"""Keyed state between polls: what is stored about a key is kept by the stream, and only new arrivals are read.

Each key's state follows the rules of :func:`newsloom.operators.store.compact`: some columns stay
as they first arrived, some become what last arrived, some keep their last known value.
Arrivals are ordered by a number, not by the order in which files or batches bring them, so
a late arrival changes only what it is the first or last of, and any cut into batches leads to
the same state.  With an event time, a timer lets a key go that nothing arrived for while the events
went on by ``idle``; it then begins anew, and rows further behind than that come too late.

The state lives in the checkpoint (for very many keys let the session name Spark's RocksDB
provider, so that it lies on disk).  Values travel as JSON of their struct, so any
type that JSON can write and read back is kept as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.commits import Tables

_STATE = "first_at long, first string, last_at long, last string, known_at array<long>, known array<string>, arrivals long"
#: Instants to the microsecond (fixed; the default stops at milliseconds).
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_OUT = f"__key string, {_STATE}, created boolean, expired boolean"


@dataclass(frozen=True)
class Rules:
    """What becomes of each column; ``arrival`` is a whole number that no two arrivals of a key share."""

    key: list[str]
    arrival: str
    first: list[str] = field(default_factory=list)
    last: list[str] = field(default_factory=list)
    last_known: list[str] = field(default_factory=list)

    def struct(self, schema: T.StructType, names: list[str]) -> T.StructType:
        return T.StructType([T.StructField(n, schema[n].dataType) for n in names])

    def output(self, schema: T.StructType) -> T.StructType:
        columns = [T.StructField(n, schema[n].dataType) for n in [*self.key, *self.first, *self.last, *self.last_known]]
        more = [T.StructField(n, T.LongType()) for n in ("arrivals", "first_arrival", "last_arrival")]
        return T.StructType(columns + more + [T.StructField(n, T.BooleanType()) for n in ("created", "expired")] + [T.StructField("batch", T.LongType())])


def _advance(before: tuple | None, chunks: Iterator) -> tuple:
    """The state after some arrivals (pandas frames of __at, __first, __last and __known)."""
    first_at, first, last_at, last, known_at, known, n = before or (None, None, None, None, None, None, 0)
    known_at, known = list(known_at or ()), list(known or ())
    for chunk in chunks:
        at = chunk["__at"].to_numpy()
        if not len(at):
            continue
        low, high = int(at.argmin()), int(at.argmax())
        if first_at is None or at[low] < first_at:
            first_at, first = int(at[low]), chunk["__first"].iloc[low]
        if last_at is None or at[high] > last_at:
            last_at, last = int(at[high]), chunk["__last"].iloc[high]
        for when, values in zip(chunk["__at"], chunk["__known"]):
            if not known:
                known_at, known = [-(2**63)] * len(values), [None] * len(values)
            for k, value in enumerate(values):
                if value is not None and when > known_at[k]:
                    known_at[k], known[k] = int(when), value
        n += len(at)
    return first_at, first, last_at, last, known_at, known, n


def keyed(stream: DataFrame, rules: Rules, event_time: str | None = None, idle: str = "30 days") -> DataFrame:
    """A row for each key of a batch: its state after the batch, and whether the batch created it.

    event_time: the timestamp by which keys are let go; the last state of such a key comes out once
    more, as ``expired``.  Rows without arrival number are left out; rows without key share one state.
    """
    if event_time:
        stream = stream.withWatermark(event_time, idle)
    schema = stream.schema
    known = [F.to_json(F.struct(F.col(c).alias("v")), _JSON) for c in rules.last_known]
    known = [F.when(F.col(c).isNotNull(), j) for c, j in zip(rules.last_known, known)]
    packed = stream.filter(F.col(rules.arrival).isNotNull()).select(
        F.to_json(F.struct(*rules.key), _JSON).alias("__key"),
        F.col(rules.arrival).cast("long").alias("__at"),
        (F.to_json(F.struct(*rules.first), _JSON) if rules.first else F.lit("{}")).alias("__first"),
        (F.to_json(F.struct(*rules.last), _JSON) if rules.last else F.lit("{}")).alias("__last"),
        (F.array(*known) if known else F.array().cast("array<string>")).alias("__known"),
        *([F.col(event_time), F.unix_millis(F.col(event_time).cast("timestamp")).alias("__ms")] if event_time else []),
    )

    def step(key, chunks, state):
        import pandas as pd

        names = ["__key", "first_at", "first", "last_at", "last", "known_at", "known", "arrivals", "created", "expired"]
        if state.hasTimedOut:
            row = state.get
            state.remove()
            yield pd.DataFrame([(key[0], *row[:-1], False, True)], columns=names)
            return
        before, seen = state.get if state.exists else None, [-1]

        def arriving():
            for chunk in chunks:
                if event_time and chunk["__ms"].notna().any():
                    seen.append(int(chunk["__ms"].max()))
                yield chunk

        after = _advance(before[:-1] if before else None, arriving())
        latest_ms = max(*seen, before[-1] if before else -1)
        state.update((*after, latest_ms))
        if event_time:
            state.setTimeoutTimestamp(max(latest_ms, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame([(key[0], *after, before is None, False)], columns=names)

    timer = "EventTimeTimeout" if event_time else "NoTimeout"
    states = packed.groupBy("__key").applyInPandasWithState(step, _OUT, f"{_STATE}, seen long", "update", timer)
    read = lambda c, names: F.from_json(c, rules.struct(schema, names), _JSON)
    parts = {"__k": read("__key", rules.key)}
    parts |= {"__f": read("first", rules.first)} if rules.first else {}
    parts |= {"__l": read("last", rules.last)} if rules.last else {}
    out = states.withColumns(parts)
    columns = [F.col("__k")[c].alias(c) for c in rules.key] + [F.col("__f")[c].alias(c) for c in rules.first]
    columns += [F.col("__l")[c].alias(c) for c in rules.last]
    for k, c in enumerate(rules.last_known):
        one = T.StructType([T.StructField("v", schema[c].dataType)])
        columns.append(F.from_json(F.get("known", F.lit(k)), one, _JSON)["v"].alias(c))
    return out.select(*columns, "arrivals", F.col("first_at").alias("first_arrival"), F.col("last_at").alias("last_arrival"), "created", "expired")


def latest(changes: DataFrame, key: list[str], batch: str = "batch") -> DataFrame:
    """The present rows of a table of changes: each key's state after the last batch that changed it, unless it was let go then."""
    rest = F.struct(*[c for c in changes.columns if c not in key])
    rows = changes.groupBy(*key).agg(F.max_by(rest, batch).alias("__row"))
    return rows.select(*key, "__row.*").filter("NOT expired")


def poll(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    rules: Rules,
    tables: Tables,
    table: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] = lambda s: s,
    files: int = 100,
    event_time: str | None = None,
    idle: str = "30 days",
) -> list[int]:
    """Takes up all files of a folder that earlier polls have not read, and commits the changed states to ``table``.

    Gives the number of rows read in each batch.  A batch that runs again after a failure is
    committed once.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    states = keyed(prepare(stream), rules, event_time, idle)

    def write(batch: DataFrame, number: int) -> None:
        with tables.transaction(f"{table}@{checkpoint}", number) as t:
            if not t.done_before:
                t.append(table, batch.withColumn("batch", F.lit(number).cast("long")))

    query = states.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
