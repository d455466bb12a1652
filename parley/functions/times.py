"""Column functions over epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS


def month_bucket(ms: Column) -> Column:
    """The calendar month ``YYYY-MM`` in UTC."""
    days = F.expr("date'1970-01-01'") + F.floor(ms / DAY_MS).cast("int")
    return F.date_format(days, "yyyy-MM")


def approximate_bucket(ms: Column) -> Column:
    """``YYYY-MM`` by years of 365 days and months of 30, the last one longer."""
    days = F.floor(ms / DAY_MS).cast("long")
    year = F.floor(days / 365)
    month = F.least(F.floor((days - year * 365) / 30), F.lit(11)) + 1
    return F.format_string("%04d-%02d", (year + 1970).cast("int"), month.cast("int"))


def bucket_start_ms(bucket: Column) -> Column:
    """The first millisecond of a month; null if the label is malformed."""
    day = F.try_to_timestamp(F.concat(bucket, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(bucket.rlike(r"^\d{4}-\d{2}$"), F.unix_date(day).cast("long") * DAY_MS)


def bucket_end_ms(bucket: Column) -> Column:
    day = F.try_to_timestamp(F.concat(bucket, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(bucket.rlike(r"^\d{4}-\d{2}$"), F.unix_date(F.add_months(day, 1)).cast("long") * DAY_MS)


def bucket_overlaps(bucket: Column, date_from: int | None, date_to: int | None) -> Column:
    """Whether a month meets the inclusive bounds; a malformed label does."""
    start, end = bucket_start_ms(bucket), bucket_end_ms(bucket)
    meets = F.lit(True)
    if date_from is not None:
        meets = meets & (end > date_from)
    if date_to is not None:
        meets = meets & (start <= date_to)
    return F.coalesce(meets, F.lit(True))


def week_start_ms(ms: Column) -> Column:
    """The Monday on or before, in whole weeks from the first one of 1970."""
    shift = 4 * DAY_MS
    return F.floor((ms - shift) / WEEK_MS).cast("long") * WEEK_MS + shift


def thirty_day_start_ms(ms: Column) -> Column:
    return F.floor(ms / (30 * DAY_MS)).cast("long") * (30 * DAY_MS)
