"""Places in a total order over a whole table, without a window that holds it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def _ranges(df: DataFrame, order: list[Column]) -> tuple[DataFrame, Column]:
    """The rows sorted in ranges, as a written table with ``__at`` (range and place in it), and the column of the range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    folder = f"{shared_folder(df.sparkSession)}/numbered-{uuid.uuid4().hex}"
    ranged.withColumn("__at", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder), F.shiftright("__at", 33)


def numbered(df: DataFrame, *order: Column, name: str = "ord") -> DataFrame:
    """Adds the place (from 1) in the order, which should end with a column that no two rows share.

    Rows are sorted in ranges that a sample of the order's values deals out, and written; a
    row's place is its place in its range, and the number of rows in the ranges before.  What
    is broadcast is one number for each range.  Rows that tie throughout stand in any order.
    """
    written, span = _ranges(df, list(order))
    counts = sorted(tuple(r) for r in written.groupBy(span.alias("r")).agg(F.count("*").alias("n")).collect())
    bases, before = [], 0
    for r, n in counts:
        bases.append((r, before - (r << 33) + 1))
        before += n
    # a row for each range
    bases = F.broadcast(df.sparkSession.createDataFrame(bases, "__range long, __base long"))
    placed = written.join(bases, span == F.col("__range"))
    return placed.select(*[written[c] for c in df.columns if c != name], (F.col("__at") + F.col("__base")).alias(name))


def renumbered(df: DataFrame, *values: Column, name: str = "ord") -> DataFrame:
    """Renews ``name``, which no two rows share, by the values (ascending, null first) and then by itself.

    Only these are sorted and written, not the rows.
    """
    narrow = df.select(F.col(name).alias("__old"), *[c.alias(f"__k{k}") for k, c in enumerate(values)])
    places = numbered(narrow, *[F.asc(f"__k{k}") for k in range(len(values))], F.asc("__old"), name="__new").select("__old", "__new")
    return df.join(places, df[name] == places["__old"]).select(*[df[c] for c in df.columns if c != name], F.col("__new").alias(name))


def numbered_within(df: DataFrame, group: str, *order: Column, name: str = "ord") -> DataFrame:
    """Adds the place (from 1) in the order of the row's group; a group of very many rows fills several ranges, and no task holds it.

    A group's offsets are one entry for each range that it fills.
    """
    written, span = _ranges(df, [F.col(group).asc_nulls_first(), *order])
    counts = written.groupBy(F.col(group).alias("__group"), span.alias("__range")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    sums = counts.groupBy("__group").agg(F.sort_array(F.collect_list(F.struct("__range", "__first", "__n"))).alias("__all"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<r:bigint,base:bigint>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        base = F.struct(x["__range"].alias("r"), (acc["sum"] - x["__first"] + 1).alias("base"))
        return F.struct((acc["sum"] + x["__n"]).alias("sum"), F.concat(acc["out"], F.array(base)).alias("out"))

    offsets = sums.select("__group", F.explode(F.aggregate("__all", start, add, lambda acc: acc["out"])).alias("y"))
    offsets = offsets.select("__group", F.col("y.r").alias("__range"), F.col("y.base").alias("__base"))
    placed = written.join(offsets, (span == offsets["__range"]) & written[group].eqNullSafe(offsets["__group"]))
    return placed.select(*[written[c] for c in df.columns if c != name], (F.col("__at") + F.col("__base")).alias(name))


def first_of_each(df: DataFrame, group: str, most: Column, *order: Column) -> DataFrame:
    """The first rows of each group, as many as the row's ``most`` says (null, zero or less: all of them)."""
    few = F.coalesce(most, F.lit(0)) > 0
    placed = numbered_within(df.filter(few), group, *order, name="__place").filter(F.col("__place") <= most).drop("__place")
    return placed.unionByName(df.filter(~few))
