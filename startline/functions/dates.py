"""Dates and times that come as text; what cannot be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from startline.functions.text import filled, strip


def iso_date(c: Column) -> Column:
    """yyyy-MM-dd or yyyyMMdd."""
    text = strip(c)
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")),
        F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")),
    )


def clock(c: Column) -> Column:
    """H:M of 24 hours, one or two digits each, as HH:mm."""
    text = strip(c)
    at = F.when(text.rlike(r"^\d{1,2}:\d{1,2}$"), F.try_to_timestamp(text, F.lit("H:m")))
    return F.date_format(at, "HH:mm")


def moment(date: Column, time: Column) -> Column:
    """The UTC timestamp of a date and a time of day, midnight if the time cannot be read; null without a date."""
    day = iso_date(date)
    return F.try_to_timestamp(F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.when(day.isNotNull(), F.coalesce(clock(time), F.lit("00:00")))), F.lit("yyyy-MM-dd HH:mm"))


def date_range(start: Column, end: Column) -> Column:
    """`start`, or `start to end` if there is another end; null without a start."""
    return F.when(filled(start), F.when(filled(end) & (start != end), F.concat(start, F.lit(" to "), end)).otherwise(start))
