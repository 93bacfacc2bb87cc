"""Dates of feeds and slots.  ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_ZONE = "Europe/Zurich"


def parse_date(c) -> Column:
    """RFC-822 or ISO text as an instant (UTC where no offset is given); null if it is neither."""
    raw = F.trim(F.col(c) if isinstance(c, str) else c)
    bare = F.regexp_replace(raw, r"^[A-Za-z]+,\s*", "")
    named = F.regexp_replace(bare, r"\s+(GMT|UT|UTC|Z)$", " +0000")
    tries = [
        F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm:ss xx")),
        F.try_to_timestamp(named, F.lit("d MMM yyyy HH:mm xx")),
        F.try_to_timestamp(F.regexp_replace(raw, "Z$", "+00:00")),
    ]
    return F.coalesce(*tries)


def first_date(*columns) -> Column:
    """The first column that holds a date that can be read."""
    return F.coalesce(*[parse_date(c) for c in columns])


def local_time(ts, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def floor_slot(local: Column, minutes: int) -> Column:
    """The slot a wall-clock time lies in; slots over an hour start with the hour."""
    minute = F.minute(local)
    return F.date_trunc("hour", local) + F.make_dt_interval(mins=(minute - minute % min(minutes, 60)).cast("int"))


def slot_number(local: Column, minutes: int, styles: int) -> Column:
    """Position in the rotation, which starts anew each midnight."""
    return F.pmod(F.floor((F.hour(local) * 60 + F.minute(local)) / minutes), F.lit(styles)).cast("int")


def in_period(ts: Column, period: str, now: Column, zone: str = LOCAL_ZONE) -> Column:
    """all, today (civil days of the zone), 24h or 7d (instants); a missing date is only in ``all``."""
    if period == "all":
        return F.lit(True)
    if period == "today":
        held = F.to_date(local_time(ts, zone)) == F.to_date(local_time(now, zone))
    else:
        held = ts >= now - F.expr({"24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS"}[period])
    return F.coalesce(held, F.lit(False))


def display(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.date_format(local_time(ts, zone), "dd.MM.yyyy HH:mm")
