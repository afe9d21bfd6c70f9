"""Date and time expressions."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import WEEKDAY_NAMES

MICROS_PER_DAY = 86_400_000_000


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp / timestamp_ntz column (UTC session)."""
    return F.unix_micros(c.cast("timestamp"))


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, floored towards minus infinity."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(MICROS_PER_DAY)).cast("bigint")


def ts_literal(value) -> Column:
    """A timestamp_ntz literal from a datetime / ISO string."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    if isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = _dt.datetime(value.year, value.month, value.day)
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def weekday(c: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(c)


def weekday_name(idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), idx + 1)


def month_start(c: Column) -> Column:
    return F.trunc(F.to_date(c), "month")


def week_start(c: Column) -> Column:
    """Monday of the week (weeks run Monday to Sunday)."""
    return F.to_date(F.date_trunc("week", c))


def day_of(c: Column) -> Column:
    return F.to_date(c)
