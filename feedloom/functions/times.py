"""Date and time functions. Zones are always explicit (default UTC)."""

from __future__ import annotations

import datetime as dt
from typing import Optional, Union

from pyspark.sql import Column, functions as F

from feedloom.functions.nested import ColumnOrName, col

MILLIS_FROM = 1_000_000_000_000  # larger epochs are milliseconds
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
DAY_FORMAT = "yyyy-MM-dd"
_MAIL_FORMAT = "MMM d HH:mm:ss Z yyyy"
CHINA = "+08:00"


def now_ms(as_of: Optional[Union[int, Column]] = None) -> Column:
    """Current epoch milliseconds, or the injected instant."""
    if as_of is None:
        return F.unix_millis(F.current_timestamp())
    return (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("bigint")


def now_seconds(as_of: Optional[Union[int, Column]] = None) -> Column:
    """Current epoch seconds."""
    return F.floor(now_ms(as_of) / 1000).cast("bigint")


def now_text(as_of: Optional[Union[int, Column]] = None, zone: str = "UTC") -> Column:
    return _in_zone(F.timestamp_millis(now_ms(as_of)), zone, TIME_FORMAT)


def today_text(as_of: Optional[Union[int, Column]] = None, zone: str = "UTC") -> Column:
    return _in_zone(F.timestamp_millis(now_ms(as_of)), zone, DAY_FORMAT)


def epoch_timestamp(c: ColumnOrName) -> Column:
    """Epoch seconds or milliseconds as an instant."""
    x = col(c).cast("bigint")
    return F.when(x > MILLIS_FROM, F.timestamp_millis(x)).otherwise(F.timestamp_seconds(x))


def _in_zone(instant: Column, zone: str, pattern: str) -> Column:
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), instant.cast("timestamp_ntz"))
    return F.date_format(local, pattern)


def epoch_text(c: ColumnOrName, zone: str = "UTC") -> Column:
    return _in_zone(epoch_timestamp(c), zone, TIME_FORMAT)


def epoch_day(c: ColumnOrName, zone: str = "UTC") -> Column:
    return _in_zone(epoch_timestamp(c), zone, DAY_FORMAT)


def text_epoch(c: ColumnOrName) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` to epoch seconds; 0 when it does not parse."""
    parsed = F.try_to_timestamp(col(c).cast("string"), F.lit(TIME_FORMAT))
    return F.coalesce(F.unix_timestamp(parsed), F.lit(0).cast("bigint"))


def _mail_time(c: Column) -> Column:
    # The weekday is skipped: Spark's parser has no pattern letter for it.
    return F.try_to_timestamp(F.substr(c, F.lit(5)), F.lit(_MAIL_FORMAT))


def mail_instant(c: ColumnOrName) -> Column:
    """Epoch seconds of ``Sat Dec 23 17:12:54 +0800 2023`` with its offset applied."""
    return F.unix_timestamp(_mail_time(col(c)))


def mail_wallclock_epoch(c: ColumnOrName) -> Column:
    """The same text with the offset ignored: its wall clock read as UTC."""
    as_utc = F.regexp_replace(col(c), r" [+-]\d{4} ", " +0000 ")
    return F.unix_timestamp(_mail_time(as_utc))


def mail_china_text(c: ColumnOrName) -> Column:
    """The same instant as text in +08:00."""
    return F.concat(_in_zone(_mail_time(col(c)), CHINA, TIME_FORMAT), F.lit(CHINA))


def check_days(start: str, end: str) -> tuple[str, str]:
    if dt.date.fromisoformat(start) > dt.date.fromisoformat(end):
        raise ValueError(f"day range starts at {start}, after its end {end}")
    return start, end


def day_begin(c: ColumnOrName, zone: str = "UTC") -> Column:
    """Epoch seconds of the first second of a day in a zone."""
    midnight = F.unix_date(col(c).cast("date")).cast("bigint") * 86400
    if zone == "UTC":
        return midnight
    return F.unix_timestamp(F.to_utc_timestamp(F.timestamp_seconds(midnight), zone))


def day_end(c: ColumnOrName, zone: str = "UTC") -> Column:
    """Epoch seconds of the last second of a day in a zone, also where clocks change on it."""
    return day_begin(F.date_add(col(c).cast("date"), 1), zone) - 1


def day_series(start: str, end: str) -> Column:
    """All days from start to end, both included."""
    check_days(start, end)
    return F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
