"""Calendar and duration expressions over timestamp or timestamp_ntz columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rush hours and the night window of the reference features.
RUSH_HOURS = [7, 8, 9, 16, 17, 18]
NIGHT_BEFORE, NIGHT_FROM = 6, 21
WEEKEND_FROM = 5          # day_of_week 5, 6 = Saturday, Sunday (0 = Monday)
MAX_DURATION_MIN = 1440


def hour(ts: Column) -> Column:
    return F.hour(ts).cast("int")


def day_of_week(ts: Column) -> Column:
    """0 = Monday … 6 = Sunday."""
    return F.weekday(ts).cast("int")


def month(ts: Column) -> Column:
    return F.month(ts).cast("int")


def year(ts: Column) -> Column:
    return F.year(ts).cast("int")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def is_weekend(dow: Column) -> Column:
    return (dow >= WEEKEND_FROM).cast("int")


def is_rush_hour(h: Column) -> Column:
    return h.isin(RUSH_HOURS).cast("int")


def is_night(h: Column) -> Column:
    return ((h < NIGHT_BEFORE) | (h >= NIGHT_FROM)).cast("int")


def season(m: Column) -> Column:
    """Dec–Feb 0, Mar–May 1, Jun–Aug 2, Sep–Nov 3."""
    return F.floor(F.pmod(m, F.lit(12)) / 3).cast("int")


def clip(c: Column, lo=None, hi=None) -> Column:
    """Null-preserving clip (``greatest``/``least`` alone would skip NULL)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo) if not isinstance(lo, Column) else lo)
    if hi is not None:
        out = F.least(out, F.lit(hi) if not isinstance(hi, Column) else hi)
    return F.when(c.isNotNull(), out)


def duration_min(start: Column, end: Column) -> Column:
    """Minutes from start to end, clipped to [0, 1440]."""
    minutes = F.timestamp_diff("MICROSECOND", start, end) / F.lit(60_000_000.0)
    return clip(minutes, 0.0, float(MAX_DURATION_MIN))


def calendar_columns(ts: Column) -> dict[str, Column]:
    h, dow, m = hour(ts), day_of_week(ts), month(ts)
    return {
        "hour": h,
        "day_of_week": dow,
        "month": m,
        "year": year(ts),
        "is_weekend": is_weekend(dow),
        "is_rush_hour": is_rush_hour(h),
        "is_night": is_night(h),
        "season": season(m),
    }
