"""Calendar parts, split labels, relative hours and time-zone shifts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Temporal splits, occupancy window and trend epoch.
SPLITS = {
    "train": ("2023-01-02", "2024-12-31"),
    "val": ("2025-01-01", "2025-06-30"),
    "test": ("2025-07-01", "2025-12-31"),
}
# US federal holidays, actual dates. (month, day) and
# (month, ISO weekday, first possible day of month).
FIXED_HOLIDAYS = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
FLOATING_HOLIDAYS = ((1, 1, 15), (2, 1, 15), (5, 1, 25), (9, 1, 1), (10, 1, 8), (11, 4, 22))


def iso_weekday(date: Column) -> Column:
    """Monday = 1 … Sunday = 7."""
    return F.weekday(date) + 1


def is_weekend(date: Column, first: int = 6) -> Column:
    """Weekend from ISO weekday ``first`` on (6 = Saturday)."""
    return iso_weekday(date) >= first


def week_start(date: Column) -> Column:
    """Monday of the week as a date."""
    return F.date_sub(date, F.weekday(date))


def month_start(date: Column) -> Column:
    return F.trunc(date, "month")


def trend_index(date: Column, epoch: str, last: int | None = None) -> Column:
    """Days since ``epoch``, held at ``last`` when given."""
    days = F.datediff(date, F.lit(epoch).cast("date"))
    return days if last is None else F.least(days, F.lit(last))


def hour_stamp(date: Column, hour: Column) -> Column:
    """Zone-free timestamp of an hour of a date."""
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour.cast("int"))


def hours_between(start: Column, end: Column) -> Column:
    """Whole clock hours from start to end (both truncated to the hour)."""
    return F.timestamp_diff("HOUR", F.date_trunc("HOUR", start), F.date_trunc("HOUR", end))


def relative_hour(date: Column, hour: Column, event_date: Column, start_hour: Column,
                  n_events: Column | None = None) -> Column:
    """Hours from the event start; NULL when the date holds several events."""
    rel = F.datediff(date, event_date) * 24 + hour - start_hour
    return rel if n_events is None else F.when(n_events == 1, rel)


def standard_to_wall_clock(ts: Column, utc_offset_hours: int, zone: str) -> Column:
    """Local standard time (fixed offset) to the zone's wall clock, DST aware."""
    utc = ts - F.make_dt_interval(F.lit(0), F.lit(utc_offset_hours))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def split_label(date: Column, splits: Mapping[str, Sequence[str]] = SPLITS) -> Column:
    """Name of the range that holds the date; NULL outside every range."""
    out = F.lit(None).cast("string")
    for name, (first, last) in splits.items():
        out = F.when(between_dates(date, first, last), F.lit(name)).otherwise(out)
    return out


def between_dates(date: Column, first: str, last: str) -> Column:
    return date.between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def week_overlaps(week: Column, first: str, last: str) -> Column:
    """The 7-day week shares at least one day with the window."""
    return (week <= F.lit(last).cast("date")) & (F.date_add(week, 6) >= F.lit(first).cast("date"))


def week_inside(week: Column, first: str, last: str) -> Column:
    """The whole 7-day week lies inside the window."""
    return (week >= F.lit(first).cast("date")) & (F.date_add(week, 6) <= F.lit(last).cast("date"))


def is_listed_date(date: Column, dates: Sequence[str]) -> Column:
    return date.isin([F.lit(d).cast("date") for d in dates])


def is_federal_holiday(date: Column) -> Column:
    """Actual holiday dates: constant days plus the n-th-weekday ones."""
    month, day = F.month(date), F.dayofmonth(date)
    out = F.lit(False)
    for m, d in FIXED_HOLIDAYS:
        out = out | ((month == m) & (day == d))
    for m, weekday, first in FLOATING_HOLIDAYS:
        out = out | ((month == m) & (iso_weekday(date) == weekday) & day.between(first, first + 6))
    return out


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a periodic value."""
    angle = value * (2.0 * 3.141592653589793 / period)
    return F.sin(angle), F.cos(angle)
