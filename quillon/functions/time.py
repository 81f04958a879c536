"""Local dates, offsets and countdowns. Instants are UTC and without a zone; the zone is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def local_date(ts: Column | str, zone: str) -> Column:
    """The date that clocks in ``zone`` show at a UTC instant."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts) if isinstance(ts, str) else ts))


def plus_days(ts: Column, days: Column | int) -> Column:
    """The instant some days later, at the same time of day."""
    return ts + F.make_dt_interval(days=F.lit(days) if isinstance(days, int) else days)


def since(ts: Column | str, as_of: str, days: int | None) -> Column:
    """Whether an instant lies in the last ``days`` days before ``as_of``, time of day included; all if None."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.lit(True) if days is None else ts >= plus_days(instant(as_of), -days)


def midnight_plus(as_of: str, zone: str, days: int) -> Column:
    """The local date ``days`` days after that of ``as_of``."""
    return F.date_add(local_date(instant(as_of), zone), days)


def calendar_date(text: Column) -> Column:
    """A strict YYYY-MM-DD date that exists, else null."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def countdown(day: Column, as_of: str, zone: str) -> Column:
    """Struct of days left (negative once past) and status: none, today, past or ahead."""
    left = F.datediff(day, local_date(instant(as_of), zone))
    status = F.when(day.isNull(), "none").when(left == 0, "today").when(left < 0, "past").otherwise("ahead")
    return F.struct(left.alias("days"), status.alias("status"))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, never below zero."""
    return F.greatest(F.timestamp_diff("SECOND", start, end), F.lit(0))
