"""Zone-less time arithmetic used across the jobs."""
from pyspark.sql import functions as F

from tideline.functions.text import strip

MICROS_PER_HOUR = 3_600_000_000.0


def parse_day_first(column, stripped=False):
    """``d/m/yyyy H:M`` to TIMESTAMP_NTZ; null for anything else (including impossible dates).

    One shape check, then plain substring work, which is far cheaper per row than a regex split.
    """
    text = column if stripped else strip(column)
    shaped = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{1,2}$"), text)
    rest = F.substring_index(shaped, "/", -1)
    clock = strip(F.substring(rest, 5, 100))
    parts = (F.substring(rest, 1, 4), F.substring_index(F.substring_index(shaped, "/", 2), "/", -1),
             F.substring_index(shaped, "/", 1), F.substring_index(clock, ":", 1), F.substring_index(clock, ":", -1))
    return F.try_make_timestamp_ntz(*[part.cast("int") for part in parts], F.lit(0))


def micros_between(start, end):
    return F.timestamp_diff("MICROSECOND", start, end)


def hours_between(start, end):
    return micros_between(start, end) / F.lit(MICROS_PER_HOUR)


def ntz(text):
    """Literal zone-less timestamp, so comparisons reach the Parquet scan."""
    return F.lit(str(text)).cast("timestamp_ntz")


def day_number(column):
    """Monday = 0."""
    return F.weekday(column)


def week_start(column):
    return F.date_add(column, -F.weekday(column))


def week_end(column):
    return F.date_add(column, 6 - F.weekday(column))


def date_key(column):
    return (F.year(column) * 10000 + F.month(column) * 100 + F.dayofmonth(column)).cast("int")


def local_date(column, zone="America/New_York"):
    return F.to_date(F.from_utc_timestamp(column, zone))
