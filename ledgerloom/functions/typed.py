"""Typed views of text columns: amounts, dates and clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(15,2)"
CLOCK = "hours int, minutes int, seconds int"


def amount(text: Column) -> Column:
    return text.try_cast(AMOUNT)


def day(text: Column) -> Column:
    """Calendar day of an ISO-8601 text; missing or malformed text gives null."""
    return F.substring(text.cast("string"), 1, 10).try_cast("date")


def clock_text(clock: Column) -> Column:
    """``hh:mm:ss`` of a ``{hours, minutes, seconds}`` object given as JSON text."""
    parts = F.from_json(clock, CLOCK)
    two = [F.lpad(parts[name].cast("string"), 2, "0") for name in ("hours", "minutes", "seconds")]
    return F.concat(two[0], F.lit(":"), two[1], F.lit(":"), two[2])


def iso_timestamp(date: Column, clock: Column) -> Column:
    """ISO-8601 text of a date text joined with a clock object."""
    return F.concat(F.substring(date, 1, 10), F.lit("T"), clock_text(clock), F.lit(".000Z"))


def timestamp(date: Column, clock: Column) -> Column:
    return F.concat(F.substring(date, 1, 10), F.lit(" "), clock_text(clock)).try_cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    return F.date_diff(end, start).cast("bigint")
