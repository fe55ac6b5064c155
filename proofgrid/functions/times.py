"""Time columns: ages against a given moment, parsing, effective times. Times without a zone are UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(when: dt.datetime) -> Column:
    """A literal without a zone, for columns of UTC times."""
    utc = when.astimezone(dt.timezone.utc) if when.tzinfo else when
    return F.expr(f"TIMESTAMP_NTZ '{utc:%Y-%m-%d %H:%M:%S.%f}'")


def age_micros(seen: Column, now: dt.datetime) -> Column:
    return F.timestamp_diff("MICROSECOND", seen.cast("timestamp_ntz"), moment(now))


def parsed(value: Column) -> Column:
    """Epoch seconds or milliseconds, or ISO 8601 text; null where it is neither."""
    number = value.try_cast("double")
    return F.coalesce(F.timestamp_micros((F.when(F.abs(number) > 1e11, number * 1000).otherwise(number * 1e6)).cast("long")), F.try_to_timestamp(value))


def effective(event_time: Column, observed: Column) -> Column:
    return F.coalesce(event_time, observed)
