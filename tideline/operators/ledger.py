"""The publication ledger: what was issued, which outcomes are final, and how well published rows did."""
from pyspark.sql import functions as F

from tideline.functions.timecols import local_date
from tideline.operators.demand import demand_shift
from tideline.operators.forecast import LEAD_BANDS, interval_score, lead_band

RETAIN_DAYS = 120
MATURE_DAYS = 7
RECENT_DAYS = 56
MIN_ROWS = 28
MIN_TARGETS = 14
WARN_COVERAGE = 80


def issuance(published, generated_at="generated_at"):
    """Rows still in the future on the New York day of publication."""
    issued = published.withColumn("issued_date", local_date(F.col(generated_at)))
    return (issued.withColumn("lead_days", F.date_diff("target", "issued_date")).filter(F.col("lead_days") > 0)
            .withColumnRenamed(generated_at, "issued_at"))


def first_publications(issued):
    """First publication per issue date wins; repeated publications of a day are dropped."""
    first = issued.groupBy("issued_date").agg(F.min("issued_at").alias("issued_at"))
    return issued.join(first, ["issued_date", "issued_at"], "left_semi")


def record_publication(issues, issued):
    """Append only issue dates the ledger does not have yet."""
    fresh = first_publications(issued)
    return issues.unionByName(fresh.join(issues.select("issued_date").distinct(), "issued_date", "left_anti"))


def retain(issues, cutoff, column="issued_date"):
    return issues.filter(F.col(column) >= F.date_sub(F.lit(cutoff), RETAIN_DAYS))


def mature_until(cutoff):
    return F.date_sub(F.lit(cutoff), MATURE_DAYS)


def pending(issues, cutoff):
    return issues.filter(F.col("target") > mature_until(cutoff))


def freeze_actuals(frozen, issues, actuals, cutoff, observed_at=None, source_sha256=None):
    """Frozen outcomes plus newly mature ones, with the time and source of their observation; a value once frozen never changes.

    ``frozen`` is None before the first run. Outcomes of targets older than the ledger keeps are let go.
    """
    wanted = issues.filter(F.col("target") <= mature_until(cutoff)).select("series", "target").distinct()
    new = actuals.select("series", F.col("day").alias("target"), "value").join(wanted, ["series", "target"], "left_semi").withColumns(
        {"observed_at": F.lit(observed_at).cast("string"), "source_sha256": F.lit(source_sha256).cast("string")})
    if frozen is None:
        return retain(new, cutoff, "target")
    new = new.join(frozen.select("series", "target"), ["series", "target"], "left_anti")
    return retain(frozen.unionByName(new, allowMissingColumns=True), cutoff, "target")


def score_ledger(issues, frozen, cutoff):
    """Mature issued rows with their frozen outcome."""
    return (issues.filter(F.col("target") <= mature_until(cutoff))
            .join(frozen.select("series", "target", F.col("value").alias("actual")), ["series", "target"]))


def recent(scored, cutoff):
    return scored.filter(F.col("target") >= F.date_sub(F.lit(cutoff), RECENT_DAYS))


def _wape(error="e", actual="a"):
    return 100 * F.sum(error) / F.nullif(F.sum(actual), F.lit(0))


def cohorts(scored, waiting, members, keys):
    """Monitoring row per key. ``members`` lists the keys to report even without scored rows.

    Rows collapse to one per (key, target) first: distinct targets then cost a count, and a hot series is combined early.
    """
    a, p = F.col("actual"), F.col("prediction")
    inside = a.between(F.col("lower"), F.col("upper"))
    per_target = scored.groupBy(*keys, "target").agg(
        F.count("*").alias("n"), F.count_if(inside).alias("hit"), F.count_if(a < F.col("lower")).alias("below"),
        F.count_if(a > F.col("upper")).alias("above"), F.sum(F.abs(p - a)).alias("e"), F.sum(a).alias("a"),
        F.sum(p - a).alias("bias"))
    totals = per_target.groupBy(*keys).agg(
        F.sum("n").alias("scored_predictions"), F.count("*").alias("distinct_target_dates"),
        F.min("target").alias("target_start"), F.max("target").alias("target_end"),
        (100 * F.sum("hit") / F.sum("n")).alias("coverage_pct"), _wape().alias("wape_pct"),
        F.sum("below").alias("below_band"), F.sum("above").alias("above_band"), (F.sum("bias") / F.sum("n")).alias("mean_bias"))
    open_rows = waiting.groupBy(*keys).agg(F.count("*").alias("awaiting_mature_actuals"))
    enough = (F.col("scored_predictions") >= MIN_ROWS) & (F.col("distinct_target_dates") >= MIN_TARGETS)
    return (members.select(*keys).distinct().join(totals, keys, "left").join(open_rows, keys, "left")
            .na.fill(0, ["scored_predictions", "distinct_target_dates", "below_band", "above_band", "awaiting_mature_actuals"])
            .withColumn("status", F.when(~enough, "Collecting outcomes")
                        .when(F.col("coverage_pct") < WARN_COVERAGE, "Undercoverage warning").otherwise("Monitoring")))


def weekly(scored):
    """WAPE and coverage by week of the target (Monday first)."""
    a = F.col("actual")
    return (scored.withColumn("week", F.date_add("target", -F.weekday("target"))).groupBy("series", "week", "target").agg(
        F.count("*").alias("n"), F.sum(F.abs(F.col("prediction") - a)).alias("e"), F.sum(a).alias("a"),
        F.count_if(a.between(F.col("lower"), F.col("upper"))).alias("hit"))
        .groupBy("series", "week").agg(F.sum("n").alias("predictions"), F.count("*").alias("dates"), _wape().alias("wape_pct"),
                                       (100 * F.sum("hit") / F.sum("n")).alias("coverage_pct")))


def by_lead(scored, members=None):
    """Count and WAPE per series and band of lead days. Every series of ``members`` (those scored, unless given) has all bands, empty ones with a count of 0."""
    a = F.col("actual")
    found = (scored.withColumn("lead", lead_band(F.col("lead_days"))).filter(F.col("lead").isNotNull()).groupBy("series", "lead").agg(
        F.count("*").alias("predictions"), (100 * F.sum(F.abs(F.col("prediction") - a)) / F.nullif(F.sum(a), F.lit(0))).alias("wape_pct")))
    bands = F.explode(F.array(*[F.lit(f"{low}–{high}") for low, high in LEAD_BANDS])).alias("lead")
    grid = (scored if members is None else members).select("series").distinct().select("series", bands)
    return grid.join(found, ["series", "lead"], "left").na.fill(0, ["predictions"])


def candidate_wape(scored):
    """Error of every candidate stored in the issued rows' map."""
    long = scored.select("series", "actual", F.explode("candidates").alias("candidate", "predicted"))
    return long.groupBy("series", "candidate").agg(
        F.count("*").alias("predictions"),
        (100 * F.sum(F.abs(F.col("predicted") - F.col("actual"))) / F.nullif(F.sum("actual"), F.lit(0))).alias("wape_pct"))


def shadow_bands(scored, waiting):
    """Published and challenger bands scored on the very same issue/target pairs, per method."""
    pairs = scored.select("series", "target", "actual", "lower", "upper", F.explode("shadow_intervals").alias("method", "band"))
    both = (pairs.select("series", "method", F.lit("reference").alias("side"), "target", "actual", "lower", "upper")
            .unionByName(pairs.select("series", "method", F.lit("challenger").alias("side"), "target", "actual",
                                      F.col("band.lower").alias("lower"), F.col("band.upper").alias("upper"))))
    scores = interval_score(both, ["series", "method", "side"])
    waits = (waiting.select("series", F.explode(F.map_keys("shadow_intervals")).alias("method"))
             .groupBy("series", "method").agg(F.count("*").alias("awaiting_mature_actuals")))
    sides = scored.sparkSession.createDataFrame([("reference",), ("challenger",)], "side string")
    methods = scores.select("series", "method").unionByName(waits.select("series", "method")).distinct()
    return (methods.crossJoin(F.broadcast(sides)).join(scores, ["series", "method", "side"], "left")
            .join(waits, ["series", "method"], "left").na.fill(0, ["awaiting_mature_actuals", "predictions", "distinct_target_dates"]))


def monitor(issues, frozen, series, cutoff, n):
    """One row per series: recent cohort, demand shift and both warnings."""
    scored = recent(score_ledger(issues, frozen, cutoff), cutoff)
    rows = cohorts(scored, pending(issues, cutoff), series.select("series"), ["series"])
    return rows.join(demand_shift(series, n), "series", "left")


def monitor_versions(issues, frozen, series, cutoff, current_version=None):
    """Cohorts kept apart by model version, including versions with pending rows only and the current one."""
    scored = recent(score_ledger(issues, frozen, cutoff), cutoff)
    members = issues.select("series", "version").distinct()
    if current_version:
        members = members.unionByName(series.select("series").distinct().withColumn("version", F.lit(current_version)))
    return cohorts(scored, pending(issues, cutoff), members, ["series", "version"])


def run_metrics(monitoring, lag_days):
    """Operational counters of one run."""
    return monitoring.agg(F.count_if(F.col("status") == "Undercoverage warning").alias("undercoverage"),
                          F.lit(1).alias("published"), F.lit(lag_days).alias("source_lag_days"))
