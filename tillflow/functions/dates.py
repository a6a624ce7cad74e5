"""Calendar expressions: period starts, labels and integer date keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_PATTERN = "yyyy-MM-dd HH:mm:ss"

# Granularity, step between two periods, periods in one year.
GRANULARITIES = {
    "daily": ("interval 1 day", 365),
    "weekly": ("interval 7 days", 52),
    "monthly": ("interval 1 month", 12),
    "quarterly": ("interval 3 months", 4),
    "yearly": ("interval 1 year", 1),
}


def date_key(c: Column | str) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def year_month(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM")


def parse_timestamp(c: Column | str) -> Column:
    """Timestamp from fixed-pattern text, NULL when the text does not parse."""
    return F.try_to_timestamp(c, F.lit(TIMESTAMP_PATTERN))


def quarter_label(c: Column | str) -> Column:
    return F.concat(F.date_format(c, "yyyy"), F.lit("Q"), F.quarter(c).cast("string"))


def period_start(c: Column | str, granularity: str) -> Column:
    """Date that names the period of ``c``.

    Weekly periods end on Monday and carry that Monday's date: a Monday belongs to the week it
    closes, a Tuesday opens the next one. All other periods carry their first day.
    """
    col = F.to_date(c)
    if granularity == "daily":
        return col
    if granularity == "weekly":
        return F.next_day(F.date_sub(col, 1), "Mon")
    unit = {"monthly": "month", "quarterly": "quarter", "yearly": "year"}[granularity]
    return F.trunc(col, unit)


def period_label(c: Column | str, granularity: str) -> Column:
    if granularity == "daily":
        return F.date_format(c, "yyyy-MM-dd")
    if granularity == "weekly":
        # Week number with Monday as first day; days before the first Monday are week 0.
        col = F.col(c) if isinstance(c, str) else c
        week = F.floor((F.dayofyear(col) + 6 - F.weekday(col)) / 7).cast("int")
        return F.concat(F.lit("W"), F.lpad(week.cast("string"), 2, "0"), F.lit(" "), F.date_format(col, "yyyy"))
    if granularity == "quarterly":
        return quarter_label(c)
    if granularity == "yearly":
        return F.date_format(c, "yyyy")
    return F.date_format(c, "MMM yyyy")
