"""Date columns: parsing, Monday weeks, windows, run keys."""

from __future__ import annotations

import datetime as dt
import warnings

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoloom import config

_DAY_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}$"


def parse_day(c: Column) -> Column:
    """A string's first ten characters as a date; null when they are no date. Never raises."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(_DAY_SHAPE), F.try_to_timestamp(head, F.lit("yyyy-M-d"))).cast("date")


def event_date(c: Column, dtype: T.DataType) -> Column:
    """A raw event time of type date, timestamp or string as a date."""
    if isinstance(dtype, T.DateType):
        return c
    if isinstance(dtype, T.StringType):
        return parse_day(c)
    return F.to_date(c)


def week_start(c: Column | str) -> Column:
    """The Monday of the week."""
    return F.date_trunc("week", c).cast("date")


def week_end(c: Column | str) -> Column:
    """The Sunday of the week."""
    return F.date_add(week_start(c), 6)


def compact_date(c: Column | str) -> Column:
    """``yyyyMMdd``."""
    return F.date_format(c, "yyyyMMdd")


def run_key(start: Column | str, end: Column | str) -> Column:
    """``start_end`` stamp of a run; ``unknown`` where a bound is missing."""
    return F.concat_ws(
        "_",
        F.coalesce(compact_date(start), F.lit("unknown")),
        F.coalesce(compact_date(end), F.lit("unknown")),
    )


def date_window(as_of: dt.date, days: int = config.DEFAULT_WINDOW_DAYS) -> tuple[dt.date, dt.date]:
    """First and last day of the window of ``days`` days that ends on ``as_of``."""
    if not config.MIN_WINDOW_DAYS <= days <= config.MAX_WINDOW_DAYS:
        raise ValueError(f"days must be between {config.MIN_WINDOW_DAYS} and {config.MAX_WINDOW_DAYS}")
    return as_of - dt.timedelta(days=days - 1), as_of


def read_bound(value: dt.date | str | None) -> dt.date | None:
    """A window bound; one that cannot be read is left out with a warning."""
    if value is None or isinstance(value, dt.date):
        return value
    if value == "":
        return None
    try:
        return dt.datetime.strptime(value, "%Y-%m-%d").date()
    except ValueError:
        warnings.warn(f"date bound {value!r} is not YYYY-MM-DD and is ignored", stacklevel=3)
        return None
