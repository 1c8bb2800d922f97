"""Date and time stamps. The run time is always an argument, so runs repeat."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_null


def today_utc(as_of: dt.datetime | dt.date | str) -> Column:
    if isinstance(as_of, str):
        return F.lit(as_of[:10]).cast("date")
    day = as_of.date() if isinstance(as_of, dt.datetime) else as_of
    return F.lit(day.isoformat()).cast("date")


def date_only(c: Column, blank: str = "-") -> Column:
    return F.coalesce(or_null(F.substring(c.cast("string"), 1, 10)), F.lit(blank))


def report_date_parts(report_date: Column, created_at: Column, now: Column) -> Column:
    """struct<date,time,full>: created_at, else report_date at the clock time of now, else now."""
    now = now.cast("timestamp_ntz")
    clock = F.date_format(now, "HH:mm:ss")
    at = F.coalesce(
        created_at.cast("timestamp_ntz"),
        F.concat_ws(" ", report_date.cast("string"), clock).try_cast("timestamp_ntz"),
        now,
    )
    date, time = F.date_format(at, "dd MMM yyyy"), F.lower(F.date_format(at, "hh:mm a"))
    return F.struct(
        date.alias("date"), time.alias("time"), F.concat(date, F.lit(" · "), time).alias("full")
    )
