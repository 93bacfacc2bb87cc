"""Slots and rotation of styles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import floor_slot, local_time, slot_number


def rotation(spark, styles: list[dict]) -> DataFrame:
    """Styles with their place in the rotation."""
    rows = [(k, s["key"], s.get("label", s["key"]), s.get("prompt", ""), s.get("language", "fr")) for k, s in enumerate(styles)]
    return spark.createDataFrame(rows, "place int, key string, label string, prompt string, language string")


def with_style(slots: DataFrame, styles: DataFrame, local: str, minutes: int, n_styles: int) -> DataFrame:
    """Each slot's style: the rotation starts anew at midnight."""
    placed = slots.withColumn("place", slot_number(F.col(local), minutes, n_styles))
    return placed.join(F.broadcast(styles), "place")  # one row for each style of the configuration


def slots_from(now: Column, minutes: int, count: int, zone: str | None = None) -> Column:
    """The next slots of a wall clock, the running one first."""
    start = floor_slot(local_time(now, zone) if zone else now, minutes)
    return F.sequence(start, start + F.make_dt_interval(mins=F.lit(minutes * (count - 1))), F.make_dt_interval(mins=F.lit(minutes)))


def all_slots(events: DataFrame, ts: str, minutes: int) -> DataFrame:
    """Every slot from the first to the last event."""
    ends = events.agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    step = F.make_dt_interval(mins=F.lit(minutes))
    return ends.filter("a IS NOT NULL").select(
        F.explode(F.sequence(floor_slot(F.col("a"), minutes), floor_slot(F.col("b"), minutes), step)).alias("slot")
    )


def open_slots(slots: DataFrame, taken: DataFrame, key: str = "slot") -> DataFrame:
    """Slots without a bulletin, whatever its status."""
    return slots.join(taken.select(key).distinct(), key, "left_anti")


def hour_plan(plan: DataFrame, latest: DataFrame, key: str = "style") -> DataFrame:
    """Each planned style with its latest bulletin; raises when the rows are read if one has none."""
    joined = plan.join(latest, key, "left")
    return joined.withColumn(
        "id", F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no bulletin for "), F.col(key)))).otherwise(F.col("id"))
    )
