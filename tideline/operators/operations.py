"""Run health and page-view aggregates."""
from pyspark.sql import Window
from pyspark.sql import functions as F

KEEP_RUNS = 30
PAGES = ("it", "forecast", "resolution")
USAGE_DAYS = 28


def latest_runs(runs, current_id=None, keep=KEEP_RUNS):
    """Latest recorded attempts before this publication (top-k, no global sort)."""
    others = runs if current_id is None else runs.filter(F.col("id") != current_id)
    return others.orderBy(F.desc("started_at"), F.desc("id")).limit(keep)


def run_health(runs, current_id=None):
    """Success rate over completed attempts and nearest-rank duration percentiles of at most thirty runs."""
    recent = latest_runs(runs, current_id)
    done = F.col("status").isin("SUCCEEDED", "FAILED")
    ranked = recent.withColumn("done", done).withColumn(
        "rank", F.row_number().over(Window.partitionBy("done").orderBy("duration_seconds")))
    counts = recent.agg(F.count("*").alias("runs"), F.count_if(done).alias("completed"),
                        F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"))
    finished = ranked.filter("done").crossJoin(counts)
    pick = lambda p: F.max(F.when(F.col("rank") == F.greatest(F.lit(1), F.ceil(F.col("completed") * F.lit(p))), F.col("duration_seconds")))
    durations = finished.agg(pick(0.5).alias("p50_seconds"), pick(0.95).alias("p95_seconds"))
    rate = 100 * F.col("succeeded") / F.nullif(F.col("completed"), F.lit(0))
    return counts.crossJoin(durations).select("runs", "completed", rate.alias("success_rate_pct"), "p50_seconds", "p95_seconds")


def page_counts(beacons):
    """Views per UTC day and page, all of them. ``beacons``: ``(page, at)``; filter ``at`` first where only some days are wanted."""
    valid = beacons.filter(F.col("page").isin(*PAGES)).withColumn("day", F.to_date("at"))
    return (valid.groupBy("day").pivot("page", list(PAGES)).count().na.fill(0)
            .withColumn("total", sum((F.col(page) for page in PAGES), F.lit(0))))


def usage_summary(counts, today, start_date=None, days=USAGE_DAYS):
    """Daily and total views over the closed days before ``today``; days before the start are left out."""
    spine = counts.sparkSession.range(1).select(F.explode(F.sequence(
        F.date_sub(F.lit(today), days), F.date_sub(F.lit(today), 1))).alias("day"))
    begin = counts.filter(F.col("day").between(F.date_sub(F.lit(today), days), F.date_sub(F.lit(today), 1))).agg(
        F.coalesce(F.lit(start_date).cast("date"), F.min("day"), F.lit(today)).alias("start"))
    return (spine.join(counts, "day", "left").na.fill(0).crossJoin(begin).filter(F.col("day") >= F.col("start"))
            .select("day", *PAGES, "total"))


def usage_totals(daily):
    return daily.agg(F.min("day").alias("start"), F.max("day").alias("through"), F.sum("total").alias("total_views"),
                     *[F.sum(page).alias(page) for page in PAGES])
