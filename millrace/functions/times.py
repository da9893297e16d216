"""Time conversions. Strings are written in the session time zone (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schemas import DATE_FORMAT, DAY_NUMBER_FORMAT, TIME_FORMAT


# What TIME_FORMAT writes.
TIME_SHAPE = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"


def millis_to_time(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def seconds_to_time(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def text_to_time(text: Column, fmt: str = TIME_FORMAT) -> Column:
    """Text as a time, null where it is not written in the format. The usual format has a fast path."""
    if fmt == TIME_FORMAT:
        return F.when(text.rlike(TIME_SHAPE), text.try_cast("timestamp"))
    return F.try_to_timestamp(text, F.lit(fmt))


def text_to_millis(text: Column, fmt: str = TIME_FORMAT) -> Column:
    return F.unix_millis(text_to_time(text, fmt))


def time_to_text(time: Column, fmt: str = TIME_FORMAT) -> Column:
    return F.date_format(time, fmt)


def millis_to_text(ms: Column, fmt: str = TIME_FORMAT) -> Column:
    """Whole seconds of an epoch in milliseconds as text."""
    return F.from_unixtime(F.floor(ms / 1000), fmt)


def millis_to_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), DATE_FORMAT)


def day_number(time: Column) -> Column:
    """A day as a number like 20240131."""
    return F.date_format(time, DAY_NUMBER_FORMAT).cast("int")


def now_millis() -> Column:
    """Version number of a mart row."""
    return F.unix_millis(F.current_timestamp())


def whole_years(birthday: Column, as_of: Column) -> Column:
    """Age in years of 365 days, cut towards zero."""
    return (F.datediff(as_of, birthday) / 365).cast("int")
