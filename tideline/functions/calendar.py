"""US federal holidays with observed days, generated per year with date arithmetic."""
from pyspark.sql import functions as F

# Month and day of fixed-date holidays; (month, weekday Monday=0, n-th) of floating ones;
# the last Monday of May.
FIXED = ((1, 1), (6, 19), (7, 4), (11, 11), (12, 25))
NTH_WEEKDAY = ((1, 0, 3), (2, 0, 3), (9, 0, 1), (10, 0, 2), (11, 3, 4))
LAST_MONDAY_MONTH = 5


def holidays(years):
    """``years``: DataFrame with an int column ``year``. Returns distinct ``(day)``."""
    fixed = [F.make_date("year", F.lit(m), F.lit(d)) for m, d in FIXED]
    observed = [F.when(F.weekday(d) == 5, F.date_sub(d, 1)).when(F.weekday(d) == 6, F.date_add(d, 1)) for d in fixed]
    floating = []
    for month, weekday, nth in NTH_WEEKDAY:
        first = F.make_date("year", F.lit(month), F.lit(1))
        floating.append(F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1)))
    last = F.last_day(F.make_date("year", F.lit(LAST_MONDAY_MONTH), F.lit(1)))
    floating.append(F.date_sub(last, F.weekday(last)))
    return (years.select(F.explode(F.array_compact(F.array(*fixed, *observed, *floating))).alias("day"))
            .distinct())


def holidays_between(spark, first_day, last_day):
    """Holidays that can touch a date range; at most twelve rows per calendar year."""
    years = spark.range(first_day.year - 1, last_day.year + 2).select(F.col("id").cast("int").alias("year"))
    return holidays(years)
