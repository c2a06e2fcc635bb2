"""Calendar arithmetic on TIMESTAMP_NTZ columns; nothing here depends on the session time zone."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickspark.names import INTERVALS

MICROSECOND = timedelta(microseconds=1)


def interval(value: str | timedelta) -> Column:
    """A day-time interval literal from a slug such as ``7D`` or from a timedelta."""
    return F.lit(INTERVALS[value] if isinstance(value, str) else value)


def start_of_day(day: Column) -> Column:
    return F.to_date(day).cast("timestamp_ntz")


def end_of_day(day: Column) -> Column:
    """The last microsecond of the day."""
    return start_of_day(day) + F.lit(timedelta(days=1)) - F.lit(MICROSECOND)


def first_day_of_month(day: Column) -> Column:
    return F.trunc(F.to_date(day), "month")


def last_day_of_month(day: Column) -> Column:
    return F.last_day(F.to_date(day))


def compact_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def floor_time(ts: Column, seconds: int) -> Column:
    """Start of the clock-aligned slot of ``seconds`` (a divisor of one day) holding ``ts``."""
    if 86_400 % seconds:
        raise ValueError(f"{seconds} seconds do not divide a day")
    of_day = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    slot = F.floor(of_day / seconds) * seconds
    return start_of_day(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), slot)


def contains_day(day: Column, start: Column, end: Column) -> Column:
    """Whether the day lies in the interval's days, both ends included."""
    return F.to_date(day).between(F.to_date(start), F.to_date(end))


def offset_bounds(end: Column, offset: str | timedelta) -> tuple[Column, Column]:
    """The interval of length ``offset`` that follows ``end``."""
    return end, end + interval(offset)


def expand_bounds(
    start: Column, end: Column, before: timedelta | None = None, after: timedelta | None = None
) -> tuple[Column, Column]:
    return (start - F.lit(before) if before else start, end + F.lit(after) if after else end)


def days_between(start: Column, end: Column) -> Column:
    """Array of every date the interval touches, both ends included."""
    return F.sequence(F.to_date(start), F.to_date(end), F.expr("INTERVAL 1 DAY"))


def months_between(start: Column, end: Column) -> Column:
    """Array of ``yyyyMM`` strings for every month the interval touches."""
    months = F.sequence(first_day_of_month(start), first_day_of_month(end), F.expr("INTERVAL 1 MONTH"))
    return F.transform(months, lambda day: F.date_format(day, "yyyyMM"))


def overlapping_bounds(start: Column, end: Column, step: timedelta, length: timedelta) -> Column:
    """Array of (start, end) sub-intervals of ``length`` every ``step``.

    Right edges stop one microsecond early and never pass ``end``; the first sub-interval whose
    right edge reaches ``end`` is the last one. Starts later than that would all satisfy
    ``start > end - length + step``, so the array ends at the first start >= end - length.
    """
    last_start = F.greatest(start, end - F.lit(length) + F.lit(step) - F.lit(MICROSECOND))
    starts = F.sequence(start, last_start, F.lit(step))
    return F.transform(
        starts,
        lambda lb: F.struct(
            lb.alias("start_inclusive"),
            F.least(lb + F.lit(length) - F.lit(MICROSECOND), end).alias("end_exclusive"),
        ),
    )


def partial_month_days(start: Column, end: Column) -> Column:
    """Days that whole-month archives do not cover at either side of [start, end]."""
    head = F.when(
        F.to_date(start) != first_day_of_month(start), days_between(start, last_day_of_month(start))
    ).otherwise(F.array().cast("array<date>"))
    tail = F.when(
        F.to_date(end) != first_day_of_month(end), days_between(first_day_of_month(end), end)
    ).otherwise(F.array().cast("array<date>"))
    return F.concat(head, tail)
