"""Date functions; every "today" is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats of report dates, tried in order.
REPORT_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd;HHmmss", "yyyyMMdd", "MM/dd/yyyy")


def business_days_since(opened: Column, today: Column) -> Column:
    """Weekdays from opened to today, both counted, less one; 0 at least, null without a date."""
    days = F.datediff(today, opened) + 1
    # whole weeks hold five; of the rest, those that fall on Monday to Friday
    first = F.weekday(opened)
    rest = F.pmod(days, F.lit(7))
    weekend = F.greatest(F.lit(0), F.least(first + rest, F.lit(7)) - F.greatest(first, F.lit(5))) + F.greatest(F.lit(0), first + rest - 12)
    count = F.floor(days / 7).cast("int") * 5 + rest - weekend
    return F.when(opened.isNotNull() & today.isNotNull(), F.when(days <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), count - 1)).cast("int"))


def notice_number(business_days: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((business_days + 4) / 5).cast("int"))


def previous_business_day(day: Column) -> Column:
    return F.date_sub(day, F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1))


def month_series(start: Column, end: Column) -> Column:
    """First days of the months from start to end; empty if end is earlier."""
    first, last = F.trunc(start, "MM"), F.trunc(end, "MM")
    return F.when(first <= last, F.sequence(first, F.greatest(first, last), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))


def report_timestamp(c: Column) -> Column:
    """UTC timestamp without zone from ISO text (with or without offset) or one of the report formats; null if none fits."""
    text = F.trim(c)
    zoned = text.rlike(r"(?:[Zz]|[+-]\d{2}:?\d{2})$") & text.contains(":")
    with_zone = F.to_utc_timestamp(F.when(zoned, text).try_cast("timestamp"), "UTC").cast("timestamp_ntz")
    plain = F.when(~zoned, text)
    parsed = [F.try_to_timestamp(plain, F.lit(f)).cast("timestamp_ntz") for f in REPORT_FORMATS]
    return F.coalesce(with_zone, plain.try_cast("timestamp_ntz"), *parsed)


def last_digits(name: Column) -> Column:
    """The last run of eight digits of a file name; null if there is none."""
    return F.try_element_at(F.regexp_extract_all(name, F.lit(r"\d{8}"), F.lit(0)), F.lit(-1))


def nav_digits(name: Column) -> Column:
    """Eight digits between _ and a non-digit or the end, else the last eight."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"_(\d{8})(?:\D|$)", 1), F.lit("")), last_digits(name))


def third_part(name: Column) -> Column:
    """The third part of a name between underscores, without the extension."""
    return F.split_part(F.split_part(name, F.lit("_"), F.lit(3)), F.lit("."), F.lit(1))


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyyMMddHHmmss")
