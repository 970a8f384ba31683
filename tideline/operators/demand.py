"""Daily demand per series: counting, validation, windows, refresh and covariates."""
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.timecols import hours_between, ntz
from tideline.operators.quantiles import exact_percentiles

TOTAL = "TOTAL"
WINDOW_DAYS = 730


def daily_demand(requests, time, area, start, end):
    """Requests per (day, area) over the half-open range ``[start, end)``; the range reaches the scan."""
    inside = requests.filter((F.col(time) >= F.lit(str(start)).cast("timestamp_ntz"))
                             & (F.col(time) < F.lit(str(end)).cast("timestamp_ntz")))
    return (inside.groupBy(F.to_date(time).alias("day"), F.col(area).alias("series"))
            .agg(F.count("*").alias("value")))


def demand_window(latest_day, today, previous_end=None, days=WINDOW_DAYS):
    """Complete window ``(start, end)``. Refuses a future, stale or regressing source."""
    if latest_day is None:
        raise ValueError("The source has no rows in the window")
    if latest_day > today:
        raise ValueError("The latest day of the source lies ahead of today")
    end = min(today - timedelta(days=2), latest_day - timedelta(days=1))
    if (today - end).days > 7:
        raise ValueError("The last complete day is over a week old")
    if previous_end is not None and previous_end > end:
        raise ValueError("The window would end before the published one")
    return end - timedelta(days=days - 1), end


def latest_day(requests, time):
    """One value; a scan of one column."""
    return requests.agg(F.max(time)).first()[0].date()


def coverage_islands(rows, keys=("series",)):
    """Stretches of consecutive days with rows: ``keys, first_day, last_day, days``. After the distinct, a key has one row a calendar day."""
    keys = list(keys)
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("day")
    days = rows.select(*keys, "day").distinct().withColumn("_island", F.date_sub("day", F.row_number().over(order)))
    return days.groupBy(*keys, "_island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")).drop("_island")


def refused_series(rows, start, end, keys=("series",)):
    """Series without a row for every day of ``[start, end]``: ``keys, islands, missing_days``. They must not be fitted; a missing day is never read as zero."""
    inside = rows.filter(F.col("day").between(F.lit(start), F.lit(end)))
    found = coverage_islands(inside, keys).groupBy(*keys).agg(F.count("*").alias("islands"), F.sum("days").alias("found"))
    whole = rows.select(*keys).distinct().join(found, list(keys), "left").na.fill(0, ["islands", "found"])
    return whole.withColumn("missing_days", F.lit((end - start).days + 1) - F.col("found")).filter("missing_days > 0").drop("found")


def refresh_demand(cached, fresh, named, start, end, today, last_full, refresh_days=60, full_days=30):
    """Rolling refresh of ``(day, series, value)``: older cached days kept, the last ``refresh_days`` replaced.

    A full rebuild is due when the last one is ``full_days`` old, or when the cache has not every day from ``start`` into the refreshed days.
    Cached ``Unknown`` is total minus named areas. Returns ``(demand, full_refresh_date)``.
    """
    refresh_from = end - timedelta(days=refresh_days - 1)
    if cached is None or (today - last_full).days >= full_days:
        return fresh, today
    covering = coverage_islands(cached, ()).filter((F.col("first_day") <= F.lit(start)) & (F.col("last_day") >= F.lit(refresh_from)))
    if covering.isEmpty():
        return fresh, today
    kept = cached.filter((F.col("day") >= F.lit(start)) & (F.col("day") < F.lit(refresh_from)))
    areas = kept.filter(F.col("series").isin(*named)).select("day", "series", "value")
    unknown = (kept.groupBy("day").agg(
        (F.sum(F.when(F.col("series") == TOTAL, F.col("value")).otherwise(0))
         - F.sum(F.when(F.col("series").isin(*named), F.col("value")).otherwise(0))).alias("value"))
        .filter("value <> 0").select("day", F.lit("Unknown").alias("series"), "value"))
    recent = fresh.filter(F.col("day") >= F.lit(refresh_from)).select("day", "series", "value")
    return areas.unionByName(unknown).unionByName(recent), last_full


def demand_violations(rows, named, start, end):
    """Problems of an extracted aggregate ``(day, series, requests text)``; a missing day is never read as zero."""
    count = F.col("requests").try_cast("bigint")
    odd = rows.filter(count.isNull() | (count <= 0) | (count.cast("string") != F.col("requests"))
                      | ~F.col("day").between(F.lit(start), F.lit(end)))
    repeated = rows.groupBy("day", "series").agg(F.count("*").alias("n")).filter("n > 1")
    spark = rows.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    grid = days.crossJoin(F.broadcast(spark.createDataFrame([(name,) for name in named], "series string")))
    missing = grid.join(rows.select("day", "series").distinct(), ["day", "series"], "left_anti")
    return (odd.select("day", "series", F.lit("invalid").alias("problem"))
            .unionByName(repeated.select("day", "series", F.lit("duplicate").alias("problem")))
            .unionByName(missing.select("day", "series", F.lit("missing").alias("problem"))))


def demand_quality(rows, named):
    """One row: days, aggregate rows and requests outside the named areas."""
    return rows.agg(F.count_distinct("day").alias("days"), F.count("*").alias("rows"),
                    F.coalesce(F.sum(F.when(F.col("series").isin(*named), 0).otherwise(F.col("value"))), F.lit(0))
                    .alias("unknown_requests"))


def demand_series(rows, start, named=None):
    """Dense long series with the total of all rows: ``(series, day, day_idx, value)``."""
    total = rows.groupBy("day").agg(F.sum("value").alias("value")).withColumn("series", F.lit(TOTAL))
    areas = rows if named is None else rows.filter(F.col("series").isin(*named))
    return (areas.select("series", "day", "value").unionByName(total.select("series", "day", "value"))
            .withColumn("day_idx", F.date_diff("day", F.lit(start))).select("series", "day", "day_idx", "value"))


def merge_covariates(cached, fresh, start, end):
    """Cached and re-read daily covariates trimmed to the range, the newest reading of a day winning."""
    both = cached.withColumn("rank", F.lit(0)).unionByName(fresh.withColumn("rank", F.lit(1)))
    rest = [name for name in cached.columns if name != "day"]
    return (both.filter(F.col("day").between(F.lit(start), F.lit(end)))
            .groupBy("day").agg(F.max_by(F.struct(*rest), "rank").alias("v")).select("day", "v.*"))


def covariate_gaps(covariates, start, end, columns=("temperature", "rain")):
    """Days of the range without a complete reading; any row refuses the covariates."""
    days = covariates.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    complete = covariates
    for name in columns:
        complete = complete.filter(F.col(name).isNotNull())
    return days.join(complete.select("day"), "day", "left_anti")


def lagged_covariates(covariates, scale=140.0):
    """Per origin day, the sums of readings 11 to 5 days earlier over ``scale``. One row per calendar day."""
    span = Window.orderBy("day").rowsBetween(-11, -5)
    return covariates.select("day", (F.sum("temperature").over(span) / F.lit(scale)).alias("temperature_lag"),
                             (F.sum("rain").over(span) / F.lit(scale)).alias("rain_lag"),
                             F.count("*").over(span).alias("readings")).filter("readings = 7").drop("readings")


def source_revisions(previous, current):
    """One row comparing two extracts of one series ``(day, value)`` on their common days."""
    delta = F.col("value") - F.col("old_value")
    return (current.join(previous.select("day", F.col("value").alias("old_value")), "day")
            .agg(F.count_if(delta != 0).alias("changed_dates"), F.coalesce(F.sum(F.abs(delta)), F.lit(0)).alias("absolute_revised"),
                 F.coalesce(F.sum(delta), F.lit(0)).alias("net_revised")))


def demand_shift(series, n):
    """Last 28-day mean against the 28 days before, per series, with a warning beyond 30 %."""
    last = F.avg(F.when(F.col("day_idx") >= n - 28, F.col("value")))
    before = F.avg(F.when((F.col("day_idx") >= n - 56) & (F.col("day_idx") < n - 28), F.col("value")))
    return (series.filter(F.col("day_idx") >= n - 56).groupBy("series").agg(last.alias("last"), before.alias("before"))
            .select("series", F.when(F.col("before") != 0, (F.col("last") / F.col("before") - 1) * 100).alias("demand_shift_pct"))
            .withColumn("demand_shift_warning", F.coalesce(F.abs("demand_shift_pct") > 30, F.lit(False))))


def history_baselines(arrivals, share=0.7):
    """Sparse-history study: MAE of four simple predictors over the last 30 % of the days (28 days kept as lead-in).

    ``arrivals``: ``(day, value)`` with gaps, one row per calendar day at most. Gaps inside the range are true zeros.
    """
    span = arrivals.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select(F.explode(F.sequence("a", "b")).alias("day"), (F.date_diff("b", "a") + 1).alias("n"), "a")
    order = Window.orderBy("day")
    dense = spine.join(arrivals, "day", "left").na.fill({"value": 0}).withColumn("i", F.date_diff("day", "a"))
    tests = (dense.withColumn("week", F.lag("value", 7).over(order))
             .withColumn("mean4", sum((F.lag("value", k).over(order) for k in (7, 14, 21, 28)), F.lit(0)) / F.lit(4.0))
             .withColumn("mean7", F.avg("value").over(order.rowsBetween(-7, -1)))
             .filter(F.col("i") >= F.greatest(F.lit(28), F.floor(F.col("n") * F.lit(share)))))
    error = lambda name: F.avg(F.abs(F.col("value") - name))
    return tests.agg(F.count("*").alias("evaluation_days"), F.min("day").alias("evaluation_start"),
                     F.avg("value").alias("mean_daily"), error(F.col("week")).alias("same_weekday_last_week"),
                     error(F.col("mean4")).alias("previous_four_same_weekdays"), error(F.col("mean7")).alias("last_7_days_mean"),
                     error(F.lit(0)).alias("zero_control"))


def history_profile(events, incident, opened, updated):
    """One row of coverage facts: spans, active and zero days, the instant by which 95 % of incidents had arrived."""
    first = events.groupBy(incident).agg(F.min(opened).alias("first")).filter(F.col("first").isNotNull())
    hours = first.withColumn("hour", hours_between(ntz("1970-01-01 00:00:00"), F.col("first")))
    late = exact_percentiles(hours, [], "hour", {"arrivals_95_percent_epoch_hour": 0.95}, width=1.0)
    days = first.groupBy(F.to_date("first").alias("day")).agg(F.count("*").alias("n"))
    arrivals = days.agg(F.sum("n").alias("incidents"), F.min("day").alias("arrival_start"), F.max("day").alias("arrival_end"),
                        F.count("*").alias("arrival_days_with_incidents"))
    rows = events.agg(F.count("*").alias("event_rows"), F.min(updated).alias("update_start"), F.max(updated).alias("update_end"))
    return (rows.crossJoin(arrivals).crossJoin(late)
            .withColumn("update_calendar_days", F.date_diff(F.to_date("update_end"), F.to_date("update_start")) + 1)
            .withColumn("arrival_calendar_days", F.date_diff("arrival_end", "arrival_start") + 1)
            .withColumn("arrival_weeks", F.col("arrival_calendar_days") / F.lit(7.0))
            .withColumn("zero_arrival_days", F.col("arrival_calendar_days") - F.col("arrival_days_with_incidents")))


def arrivals_by_month(events, incident, opened):
    return (events.groupBy(incident).agg(F.min(opened).alias("first")).filter(F.col("first").isNotNull())
            .groupBy(F.date_format("first", "yyyy-MM").alias("month")).agg(F.count("*").alias("incidents")))
