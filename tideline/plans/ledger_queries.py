"""Queries over the publication ledger, run health and page views."""
from datetime import timedelta

from pyspark.sql import functions as F

from tideline.operators import forecast as fc
from tideline.operators import ledger as ld
from tideline.operators import operations as op
from tideline.plans.demand_queries import dense
from tideline.plans.demand_sql import N, OBS_SQL
from tideline.plans.registry import query, rounded
from tideline.session import materialize, read_table

SPLIT = N - 60


def issued_rows(series):
    """Baseline predictions of every daily origin as publications two days later, with a second one the same day."""
    rows = fc.baseline_predictions(fc.horizon_rows(fc.panel(series).filter(F.col("day_idx") >= 27)))
    point = F.bround("four_week_mean", 0)
    morning = F.date_add("day", 2).cast("timestamp_ntz").cast("timestamp") + F.expr("INTERVAL 210 MINUTES")
    return rows.select(
        "series", "target", morning.alias("generated_at"), F.col("day").alias("source_through"), "day_idx", "horizon",
        F.lit("four_week_mean").alias("model"), F.when(F.col("day_idx") < SPLIT, "v1").otherwise("v2").alias("version"),
        point.cast("bigint").alias("prediction"), F.floor(F.col("four_week_mean") * F.lit(0.9)).alias("lower"),
        F.ceil(F.col("four_week_mean") * F.lit(1.1)).alias("upper"),
        F.create_map(F.lit("same_weekday"), F.col("same_weekday"), F.lit("four_week_mean"), F.bround("four_week_mean", 2)).alias("candidates"),
        F.when(F.col("day_idx") % 2 == 0, F.create_map(F.lit(fc.BAND_METHOD), F.struct(
            F.floor(F.col("four_week_mean") * F.lit(0.85)).alias("lower"), F.ceil(F.col("four_week_mean") * F.lit(1.15)).alias("upper"))))
        .otherwise(F.expr("cast(map() as map<string,struct<lower:bigint,upper:bigint>>)")).alias("shadow_intervals"))


def series_and_cutoff(spark, sf_dir):
    series = dense(spark, sf_dir)
    return series, series.agg(F.max("day")).first()[0]


def issues(series, cutoff):
    """Retained issues of the ledger, one publication per New York day."""
    return ld.retain(ld.issuance(issued_rows(series)), cutoff)


ISSUED_SQL = OBS_SQL + f""", published AS (SELECT series, target, CAST(day + 2 AS TIMESTAMP) + INTERVAL 210 MINUTE AS generated_at, day AS source_through, day_idx, horizon,
    CASE WHEN day_idx < {SPLIT} THEN 'v1' ELSE 'v2' END AS version, CAST(round_even((lag1 + lag2 + lag3 + lag4) / 4, 0) AS BIGINT) AS prediction,
    CAST(floor((lag1 + lag2 + lag3 + lag4) / 4 * CAST(0.9 AS DOUBLE)) AS BIGINT) AS lower, CAST(ceil((lag1 + lag2 + lag3 + lag4) / 4 * CAST(1.1 AS DOUBLE)) AS BIGINT) AS upper,
    lag1 AS same_weekday, round_even((lag1 + lag2 + lag3 + lag4) / 4, 2) AS four_week_mean, day_idx % 2 = 0 AS has_shadow,
    CAST(floor((lag1 + lag2 + lag3 + lag4) / 4 * CAST(0.85 AS DOUBLE)) AS BIGINT) AS shadow_lower, CAST(ceil((lag1 + lag2 + lag3 + lag4) / 4 * CAST(1.15 AS DOUBLE)) AS BIGINT) AS shadow_upper FROM obs),
issued AS (SELECT *, CAST(generated_at - INTERVAL 5 HOUR AS DATE) AS issued_date,
    CAST(date_diff('day', CAST(generated_at - INTERVAL 5 HOUR AS DATE), target) AS INTEGER) AS lead_days FROM published
  WHERE target > CAST(generated_at - INTERVAL 5 HOUR AS DATE)),
issues AS (SELECT * FROM issued, bounds WHERE issued_date >= last_day - 120),
scored AS (SELECT i.*, d.value AS actual FROM issues i JOIN demand d ON d.series = i.series AND d.day = i.target WHERE i.target <= last_day - 7),
recent AS (SELECT * FROM scored WHERE target >= last_day - 56), waiting AS (SELECT * FROM issues WHERE target > last_day - 7)"""


@query("q_issuance", "WITH " + ISSUED_SQL + """ SELECT series, target, issued_date, source_through, lead_days, version, prediction, lower, upper FROM issued""")
def issuance(spark, sf_dir):
    return ld.issuance(issued_rows(dense(spark, sf_dir))).select(
        "series", "target", "issued_date", "source_through", "lead_days", "version", "prediction", "lower", "upper")


@query("q_issue_ledger", "WITH " + ISSUED_SQL + """ SELECT series, target, issued_date, lead_days, prediction FROM issues""")
def issue_ledger(spark, sf_dir):
    """Every publication is repeated an hour later with other numbers and offered twice; first ones stay."""
    series, cutoff = series_and_cutoff(spark, sf_dir)
    first = issued_rows(series)
    again = (first.withColumn("generated_at", F.col("generated_at") + F.expr("INTERVAL 20 MINUTES"))
             .withColumn("prediction", F.col("prediction") + 1))
    offered = ld.issuance(first.unionByName(again))
    state = ld.record_publication(offered.limit(0), offered.filter(F.col("day_idx") < SPLIT))
    state = ld.record_publication(state, offered)
    return ld.retain(state, cutoff).select("series", "target", "issued_date", "lead_days", "prediction")


@query("q_freeze_actuals", "WITH " + ISSUED_SQL + """ SELECT DISTINCT i.series, i.target, d.value + 5 AS value, 'first run' AS observed_at, repeat('a', 64) AS source_sha256
FROM issued i JOIN demand d ON d.series = i.series AND d.day = i.target, bounds b WHERE i.target BETWEEN b.last_day - 120 AND b.last_day - 60
UNION ALL SELECT DISTINCT i.series, i.target, d.value, 'second run', repeat('b', 64)
FROM (SELECT series, target FROM issues) i JOIN demand d ON d.series = i.series AND d.day = i.target, bounds b WHERE i.target > b.last_day - 60 AND i.target <= b.last_day - 7""")
def freeze_actuals(spark, sf_dir):
    """Outcomes frozen earlier (with other values, of all issues) survive as far as the ledger keeps them; newly mature ones are added with their own source."""
    series, cutoff = series_and_cutoff(spark, sf_dir)
    every = ld.issuance(issued_rows(series))
    old = every.filter(F.col("target") <= F.lit(cutoff - timedelta(days=60)))
    frozen = ld.freeze_actuals(None, old, series.withColumn("value", F.col("value") + 5), cutoff, "first run", "a" * 64)
    return ld.freeze_actuals(materialize(frozen, "frozen"), ld.retain(every, cutoff), series, cutoff, "second run", "b" * 64)


def ledger_state(spark, sf_dir):
    series, cutoff = series_and_cutoff(spark, sf_dir)
    kept = materialize(issues(series, cutoff), "issues")
    frozen = materialize(ld.freeze_actuals(None, kept, series, cutoff), "frozen")
    return series, cutoff, kept, frozen


def recent(spark, sf_dir):
    _, cutoff, kept, frozen = ledger_state(spark, sf_dir)
    return ld.recent(ld.score_ledger(kept, frozen, cutoff), cutoff)


@query("q_score_ledger", "WITH " + ISSUED_SQL + " SELECT series, target, issued_date, lead_days, prediction, lower, upper, actual FROM scored")
def score_ledger(spark, sf_dir):
    _, cutoff, kept, frozen = ledger_state(spark, sf_dir)
    return ld.score_ledger(kept, frozen, cutoff).select("series", "target", "issued_date", "lead_days", "prediction", "lower", "upper", "actual")


@query("q_pending", "WITH " + ISSUED_SQL + " SELECT series, version, count(*) AS awaiting_mature_actuals FROM waiting GROUP BY 1, 2")
def pending(spark, sf_dir):
    series, cutoff = series_and_cutoff(spark, sf_dir)
    return ld.pending(issues(series, cutoff), cutoff).groupBy("series", "version").agg(F.count("*").alias("awaiting_mature_actuals"))


COHORT_COLUMNS = """count(r.target) AS scored_predictions, count(DISTINCT r.target) AS distinct_target_dates, min(r.target) AS target_start, max(r.target) AS target_end,
  round(100 * avg(CASE WHEN r.target IS NULL THEN NULL WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage_pct,
  round(100 * sum(abs(prediction - actual)) / nullif(sum(actual), 0), 6) AS wape_pct, count(*) FILTER (WHERE actual < lower) AS below_band,
  count(*) FILTER (WHERE actual > upper) AS above_band, round(avg(prediction - actual), 6) AS mean_bias"""
STATUS_SQL = """CASE WHEN scored_predictions < 28 OR distinct_target_dates < 14 THEN 'Collecting outcomes' WHEN coverage_pct < 80 THEN 'Undercoverage warning' ELSE 'Monitoring' END AS status"""


@query("q_monitor_cohorts", "WITH " + ISSUED_SQL + f""", members AS (SELECT DISTINCT series, version FROM issues UNION SELECT DISTINCT series, 'v3' FROM demand),
c AS (SELECT m.series, m.version, {COHORT_COLUMNS} FROM members m LEFT JOIN recent r ON r.series = m.series AND r.version = m.version GROUP BY ALL)
SELECT c.*, coalesce(w.n, 0) AS awaiting_mature_actuals, {STATUS_SQL} FROM c
LEFT JOIN (SELECT series, version, count(*) AS n FROM waiting GROUP BY 1, 2) w ON w.series = c.series AND w.version = c.version""")
def monitor_cohorts(spark, sf_dir):
    series, cutoff, kept, frozen = ledger_state(spark, sf_dir)
    return rounded(ld.monitor_versions(kept, frozen, series, cutoff, "v3"))


MONITOR_SQL = ISSUED_SQL + f""", c AS (SELECT series, {COHORT_COLUMNS.replace('r.target', 'target')} FROM recent GROUP BY series),
halves AS (SELECT series, avg(value) FILTER (WHERE day_idx >= {N - 28}) AS a, avg(value) FILTER (WHERE day_idx >= {N - 56} AND day_idx < {N - 28}) AS b
  FROM demand GROUP BY series),
monitored AS (SELECT c.*, coalesce(w.n, 0) AS awaiting_mature_actuals, {STATUS_SQL}, round((a / b - 1) * 100, 6) AS demand_shift_pct,
  abs((a / b - 1) * 100) > 30 AS demand_shift_warning FROM c JOIN halves h ON h.series = c.series
  LEFT JOIN (SELECT series, count(*) AS n FROM waiting GROUP BY 1) w ON w.series = c.series)"""


@query("q_monitor", "WITH " + MONITOR_SQL + " SELECT * FROM monitored")
def monitor(spark, sf_dir):
    series, cutoff, kept, frozen = ledger_state(spark, sf_dir)
    return rounded(ld.monitor(kept, frozen, series, cutoff, N))


@query("q_run_metrics", "WITH " + MONITOR_SQL + """ SELECT count(*) FILTER (WHERE status = 'Undercoverage warning') AS undercoverage, 1 AS published,
  2 AS source_lag_days FROM monitored""")
def run_metrics(spark, sf_dir):
    series, cutoff, kept, frozen = ledger_state(spark, sf_dir)
    return ld.run_metrics(ld.monitor(kept, frozen, series, cutoff, N), 2)


@query("q_monitor_weekly", "WITH " + ISSUED_SQL + """ SELECT series, target - CAST(isodow(target) - 1 AS INTEGER) AS week, count(*) AS predictions, count(DISTINCT target) AS dates,
  round(100 * sum(abs(prediction - actual)) / nullif(sum(actual), 0), 6) AS wape_pct,
  round(100 * avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage_pct FROM recent GROUP BY 1, 2""")
def monitor_weekly(spark, sf_dir):
    return rounded(ld.weekly(recent(spark, sf_dir)))


@query("q_monitor_lead", "WITH " + ISSUED_SQL + """, grid AS (SELECT DISTINCT series, a, b, lead FROM demand, (VALUES (1, 3, '1–3'), (4, 7, '4–7'), (8, 14, '8–14')) t(a, b, lead)),
short AS (SELECT * FROM recent WHERE lead_days <= 7 OR series = 'F')
SELECT g.series, lead, count(r.target) AS predictions, round(100 * sum(abs(prediction - actual)) / nullif(sum(actual), 0), 6) AS wape_pct
FROM grid g LEFT JOIN short r ON r.series = g.series AND r.lead_days BETWEEN a AND b GROUP BY 1, 2""")
def monitor_lead(spark, sf_dir):
    """Only one series has predictions of the longest band here; the others show it empty."""
    rows = recent(spark, sf_dir).filter("lead_days <= 7 OR series = 'F'")
    return rounded(ld.by_lead(rows, dense(spark, sf_dir)))


@query("q_candidate_wape", "WITH " + ISSUED_SQL + """, long AS (SELECT series, 'same_weekday' AS candidate, same_weekday AS p, actual FROM recent
  UNION ALL SELECT series, 'four_week_mean', four_week_mean, actual FROM recent)
SELECT series, candidate, count(*) AS predictions, round(100 * sum(abs(p - actual)) / nullif(sum(actual), 0), 6) AS wape_pct FROM long GROUP BY 1, 2""")
def candidate_wape(spark, sf_dir):
    return rounded(ld.candidate_wape(recent(spark, sf_dir)))


@query("q_shadow_bands", "WITH " + ISSUED_SQL + f""", pairs AS (
  SELECT series, 'reference' AS side, target, actual, lower, upper FROM recent WHERE has_shadow
  UNION ALL SELECT series, 'challenger', target, actual, shadow_lower, shadow_upper FROM recent WHERE has_shadow)
SELECT p.series, '{fc.BAND_METHOD}' AS method, side, count(*) AS predictions, count(DISTINCT target) AS distinct_target_dates,
  round(100 * avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage_pct, round(avg(upper - lower), 6) AS mean_width,
  round(avg(upper - lower + 20 * greatest(lower - actual, 0) + 20 * greatest(actual - upper, 0)), 6) AS mean_interval_score,
  any_value(w.n) AS awaiting_mature_actuals FROM pairs p JOIN (SELECT series, count(*) AS n FROM waiting WHERE has_shadow GROUP BY 1) w ON w.series = p.series
GROUP BY p.series, side""")
def shadow_bands(spark, sf_dir):
    _, cutoff, kept, frozen = ledger_state(spark, sf_dir)
    return rounded(ld.shadow_bands(ld.recent(ld.score_ledger(kept, frozen, cutoff), cutoff), ld.pending(kept, cutoff)))


# ---- operations ---------------------------------------------------------------------------------------------

@query("q_run_health", """WITH runs AS (SELECT o_orderkey AS id, o_orderdate AS started_at, o_totalprice / 1000 AS duration_seconds,
    CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN 'FAILED' ELSE 'STARTED' END AS status FROM orders),
latest AS (SELECT * FROM runs WHERE id <> (SELECT max(id) FROM runs) ORDER BY started_at DESC, id DESC LIMIT 30),
ranked AS (SELECT *, row_number() OVER (ORDER BY duration_seconds) AS r, count(*) OVER () AS n FROM latest WHERE status <> 'STARTED')
SELECT (SELECT count(*) FROM latest) AS runs, count(*) AS completed, round(100.0 * count(*) FILTER (WHERE status = 'SUCCEEDED') / count(*), 6) AS success_rate_pct,
  round(max(duration_seconds) FILTER (WHERE r = greatest(1, ceil(n * CAST(0.5 AS DOUBLE)))), 6) AS p50_seconds,
  round(max(duration_seconds) FILTER (WHERE r = greatest(1, ceil(n * CAST(0.95 AS DOUBLE)))), 6) AS p95_seconds FROM ranked""")
def run_health(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").when(F.col("o_orderstatus") == "P", "FAILED").otherwise("STARTED")
    runs = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("started_at"),
                                                      (F.col("o_totalprice") / 1000).alias("duration_seconds"), status.alias("status"))
    current = runs.agg(F.max("id")).first()[0]
    return rounded(op.run_health(runs, current))


def beacons(spark, sf_dir):
    page = (F.when(F.col("event_type") == "view", "it").when(F.col("event_type") == "click", "forecast")
            .when(F.col("event_type") == "purchase", "resolution").otherwise("other"))
    return read_table(spark, sf_dir, "events").select(page.alias("page"), F.col("ts").alias("at"), F.col("event_id").alias("id"))


PAGE_SQL = """beacons AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 'it' WHEN 'click' THEN 'forecast' WHEN 'purchase' THEN 'resolution' END AS page FROM events),
accepted AS (SELECT * FROM beacons WHERE page IS NOT NULL),
counts AS (SELECT day, count(*) FILTER (WHERE page = 'it') AS it, count(*) FILTER (WHERE page = 'forecast') AS forecast,
  count(*) FILTER (WHERE page = 'resolution') AS resolution, count(*) AS total FROM accepted GROUP BY day)"""


@query("q_page_views", "WITH " + PAGE_SQL + """ SELECT d.day, coalesce(it, 0) AS it, coalesce(forecast, 0) AS forecast, coalesce(resolution, 0) AS resolution, coalesce(total, 0) AS total
FROM (SELECT CAST(unnest(generate_series(max(day) - 27, max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM counts) d LEFT JOIN counts c ON c.day = d.day
WHERE d.day >= (SELECT min(day) FROM counts)""")
def page_views(spark, sf_dir):
    """The closed 28 days before the day after the log ends; earlier beacons are left out before they are counted."""
    rows = beacons(spark, sf_dir)
    today = rows.agg(F.to_date(F.max("at"))).first()[0] + timedelta(days=1)
    return op.usage_summary(op.page_counts(rows.filter(F.col("at") >= F.lit(today - timedelta(days=op.USAGE_DAYS)))), today)


@query("q_page_totals", "WITH " + PAGE_SQL + """ SELECT max(day) - 27 AS start, max(day) AS through, CAST(sum(total) AS BIGINT) AS total_views, CAST(sum(it) AS BIGINT) AS it,
  CAST(sum(forecast) AS BIGINT) AS forecast, CAST(sum(resolution) AS BIGINT) AS resolution FROM counts WHERE day >= (SELECT max(day) - 27 FROM counts)""")
def page_totals(spark, sf_dir):
    rows = beacons(spark, sf_dir)
    today = rows.agg(F.to_date(F.max("at"))).first()[0] + timedelta(days=1)
    return op.usage_totals(op.usage_summary(op.page_counts(rows.filter(F.col("at") >= F.lit(today - timedelta(days=28)))), today, start_date=today - timedelta(days=28)))
