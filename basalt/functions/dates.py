"""Calendar arithmetic and publication cutoffs, in plain Python and as columns."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK, SHANGHAI = ZoneInfo("America/New_York"), ZoneInfo("Asia/Shanghai")
#: Local hour from which yesterday's minute file is expected.
MINUTE_FILE_HOUR = 6


def add_days(day: dt.date, n: int) -> dt.date:
    return day + dt.timedelta(days=n)


def add_years(day: dt.date, n: int) -> dt.date:
    """The same month and day; 29 February rolls on to 1 March where there is none."""
    try:
        return day.replace(year=day.year + n)
    except ValueError:
        return dt.date(day.year + n, 3, 1)


def is_weekend(day: dt.date) -> bool:
    return day.weekday() >= 5


def weekdays_between(first: dt.date, last: dt.date) -> list[dt.date]:
    """Weekdays from ``first`` to ``last``, both included."""
    if first > last:
        raise ValueError(f"{first} is after {last}")
    days = (first + dt.timedelta(days=i) for i in range((last - first).days + 1))
    return [d for d in days if not is_weekend(d)]


def _local(now: dt.datetime, zone: ZoneInfo) -> dt.datetime:
    return now.astimezone(zone)


def latest_completed_trading_date(now: dt.datetime) -> dt.date:
    """Yesterday in New York."""
    return add_days(_local(now, NEW_YORK).date(), -1)


def latest_published_minute_date(now: dt.datetime) -> dt.date:
    """Yesterday in New York once its file is due, the day before until then."""
    t = _local(now, NEW_YORK)
    return add_days(t.date(), -1 if t.hour >= MINUTE_FILE_HOUR else -2)


def latest_completed_cn_trading_date(now: dt.datetime) -> dt.date:
    """Yesterday in Shanghai."""
    return add_days(_local(now, SHANGHAI).date(), -1)


def add_years_col(day: Column, n: int) -> Column:
    """:func:`add_years` as a column."""
    moved = F.add_months(day, 12 * n)
    return F.when(F.dayofmonth(moved) == F.dayofmonth(day), moved).otherwise(F.date_add(moved, 1))


def completed_date(now: Column, zone: str) -> Column:
    """The day before a UTC timestamp's local date, as a column."""
    return F.date_sub(F.to_date(F.from_utc_timestamp(now, zone)), 1)


def published_minute_date(now: Column) -> Column:
    """:func:`latest_published_minute_date` as a column."""
    local = F.from_utc_timestamp(now, NEW_YORK.key)
    return F.date_sub(F.to_date(local), F.when(F.hour(local) >= MINUTE_FILE_HOUR, 1).otherwise(2))


def weekdays(first: Column, last: Column) -> Column:
    """Array of the weekdays between two dates."""
    return F.filter(F.sequence(first, last, F.expr("interval 1 day")), lambda d: F.weekday(d) < 5)


def local_minute(ts: Column, zone: str) -> Column:
    """Minutes since local midnight of a UTC timestamp."""
    t = F.from_utc_timestamp(ts, zone)
    return F.hour(t) * 60 + F.minute(t)
