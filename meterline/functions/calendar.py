"""Date and time column expressions, all independent of the session time zone
for TIMESTAMP_NTZ input."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from meterline import schemas as S
from meterline.functions.numeric import cut

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def seconds_between(start: Column, end: Column) -> Column:
    """Exact seconds. Subtracting TIMESTAMP_NTZ values never consults the
    session zone, as ``timestampdiff`` would."""
    return (end - start).cast("interval second").cast("decimal(20,6)")


def parse_ts(value: Column) -> Column:
    """Any timestamp-like value to TIMESTAMP_NTZ; unparsable text gives null."""
    return value.cast("string").try_cast("timestamp_ntz")


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def day_of(ts: Column) -> Column:
    return F.dayofmonth(ts)


def weekday_of(ts: Column) -> Column:
    """Monday is 0 (``dayofweek`` would start at Sunday = 1)."""
    return F.weekday(ts)


def month_of(ts: Column) -> Column:
    return F.month(ts)


def year_of(ts: Column) -> Column:
    return F.year(ts)


def duration_minutes(start: Column, end: Column) -> Column:
    """Minutes with fraction; negative when the trip ends before it starts."""
    return seconds_between(start, end).cast("double") / 60.0


def is_weekend(weekday: Column) -> Column:
    return (weekday >= 5).cast("int")


def time_of_day_cut(hour: Column) -> Column:
    return cut(hour, S.TIME_OF_DAY_EDGES, S.TIME_OF_DAY_LABELS, include_lowest=True)


def time_of_day_rule(hour: Column) -> Column:
    return (
        F.when((hour >= 6) & (hour < 12), "morning")
        .when((hour >= 12) & (hour < 17), "afternoon")
        .when((hour >= 17) & (hour < 21), "evening")
        .otherwise("night")
    )


def is_rush_hour(hour: Column, weekday: Column | None = None, variant: str = "train") -> Column:
    """Rush-hour flag.

    ``train``: weekdays 7-9 and 16-19; ``serve``: 16-19 on any day;
    ``ui``: hours 7, 8, 9, 17, 18, 19 on any day.
    """
    if variant == "train":
        if weekday is None:
            raise ValueError("variant 'train' needs the weekday")
        hit = (hour.between(7, 9) | hour.between(16, 19)) & (weekday < 5)
    elif variant == "serve":
        hit = hour.between(16, 19)
    elif variant == "ui":
        hit = hour.isin(7, 8, 9, 17, 18, 19)
    else:
        raise ValueError(f"unknown rush-hour variant: {variant}")
    return hit.cast("int")


def day_name(weekday: Column) -> Column:
    names = F.array(*[F.lit(x) for x in S.DAY_NAMES])
    return F.try_element_at(names, (weekday + 1).cast("int"))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = F.lit(2.0 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def cyclic_shift(value: Column, by: int, period: int = 24) -> Column:
    return F.pmod(value + F.lit(by), F.lit(period))


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 text with six fraction digits, or none for a whole second."""
    text = ts.cast("string")
    fraction = F.substring(text, 21, 6)
    return F.concat(
        F.substring(text, 1, 10),
        F.lit("T"),
        F.substring(text, 12, 8),
        F.when(fraction != "", F.concat(F.lit("."), F.rpad(fraction, 6, "0"))).otherwise(""),
    )


def to_instant(ts_ntz: Column) -> Column:
    """TIMESTAMP_NTZ read as UTC, for operators that need an instant."""
    seconds = seconds_between(F.expr(_EPOCH), ts_ntz)
    return F.timestamp_micros((seconds * 1_000_000).cast("bigint"))


def from_instant(ts: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(ts), F.expr(_EPOCH))
