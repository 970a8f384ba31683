"""Queries over the audit log: validation, snapshot, star schema, reports and gates."""
from pyspark.sql import functions as F

from tideline.operators import history, normalize, reports, star
from tideline.plans.audit import (AUDIT_SQL, CHECKED_SQL, CUTOFF, DAILY_SQL, RAW_SOURCE, SEEN_SQL, SNAPSHOT_SQL, audit,
                                  checked_rows, raw_rows)
from tideline.plans.registry import query, rounded
from tideline.functions.text import clean_text
from tideline.functions.timecols import parse_day_first
from tideline.session import materialize

SNAPSHOT_COLUMNS = ("incident_id", "event_id", "source_row", "state", "opened_at", "updated_at", "sys_mod_count", "priority",
                    "assignment_group", "category", "contact_type", "reopen_count", "reassignment_count",
                    "first_observed_at", "observed_resolution_at", "is_open", "resolution_hours", "age_hours")
KEY_COLUMNS = ("group_key", "priority_key", "opened_date_key", "snapshot_date_key")


def snapshot(spark, sf_dir, cutoff=CUTOFF):
    return history.incident_snapshot(history.segment_summary(audit(spark, sf_dir), cutoff), cutoff)


def saved_snapshot(spark, sf_dir):
    """Snapshot with keys, written once where a query reads it several times."""
    return materialize(history.snapshot_keys(snapshot(spark, sf_dir), CUTOFF), "snapshot")


def dimensions(spark, sf_dir):
    events = audit(spark, sf_dir)
    return (star.dim_assignment_group(events, CUTOFF), star.dim_priority(events, CUTOFF), star.dim_date(events, CUTOFF))


def daily(spark, sf_dir):
    return history.daily_queue(history.segment_summary(audit(spark, sf_dir), CUTOFF), CUTOFF)


# ---- validation ---------------------------------------------------------------------------------------------

@query("q_clean_dimensions", "WITH " + CHECKED_SQL + """
SELECT source_row, priority, assignment_group, clean_category AS category, contact_type FROM checked""")
def clean_dimensions(spark, sf_dir):
    return raw_rows(spark, sf_dir).select("source_row", *[clean_text(F.col(name)).alias(name)
                                                          for name in normalize.DIMENSIONS])


@query("q_parse_times", "WITH " + CHECKED_SQL + """
SELECT source_row, CASE WHEN NOT bad_open AND NOT no_open THEN opened_at END AS opened, parsed_update AS updated FROM checked""")
def parse_times(spark, sf_dir):
    return raw_rows(spark, sf_dir).select("source_row", parse_day_first(F.col("opened_at")).alias("opened"),
                                          parse_day_first(F.col("sys_updated_at")).alias("updated"))


@query("q_validate_rows", "WITH " + CHECKED_SQL + " SELECT source_row, errors FROM checked")
def validate_rows(spark, sf_dir):
    return checked_rows(spark, sf_dir).select("source_row", F.concat_ws(",", "errors").alias("errors"))


@query("q_quarantine", "WITH " + CHECKED_SQL + f"""
SELECT sha256('{RAW_SOURCE}:' || CAST(source_row AS VARCHAR)) AS event_id, source_row, errors FROM checked WHERE errors <> ''""")
def quarantine(spark, sf_dir):
    return (normalize.quarantined(checked_rows(spark, sf_dir))
            .withColumn("errors", F.concat_ws(",", "errors")))


@query("q_reject_reasons", "WITH " + CHECKED_SQL + """
SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(errors, ',')) AS reason FROM checked WHERE errors <> '')
GROUP BY reason""")
def reject_reasons(spark, sf_dir):
    return normalize.reject_reasons(checked_rows(spark, sf_dir))


@query("q_load_quality", "WITH " + CHECKED_SQL + f"""
SELECT count(*) AS source_rows, count(*) FILTER (WHERE errors = '') AS accepted_rows,
  count(*) FILTER (WHERE errors <> '') AS rejected_rows,
  round(count(*) FILTER (WHERE errors <> '') / CAST(count(*) AS DOUBLE), 6) AS reject_rate,
  '{RAW_SOURCE}' AS source_sha256 FROM checked""")
def load_quality(spark, sf_dir):
    return rounded(normalize.load_quality(checked_rows(spark, sf_dir)))


@query("q_quality_gate", "WITH " + CHECKED_SQL + """
SELECT round(count(*) FILTER (WHERE errors <> '') / CAST(count(*) AS DOUBLE), 6) AS reject_rate,
  count(*) FILTER (WHERE errors = '') AS events,
  count(*) FILTER (WHERE errors <> '') <= 0.01 * count(*) AND count(*) FILTER (WHERE errors = '') > 0 AS passed FROM checked""")
def quality_gate(spark, sf_dir):
    quality = normalize.load_quality(checked_rows(spark, sf_dir)).withColumnRenamed("accepted_rows", "events")
    return rounded(normalize.quality_gate(quality))


# ---- snapshot, flows, history -------------------------------------------------------------------------------

@query("q_incident_snapshot", "WITH " + SNAPSHOT_SQL + """
SELECT incident_id, event_id, source_row, state, opened_at, updated_at, sys_mod_count, priority, assignment_group, category,
  contact_type, reopen_count, reassignment_count, first_observed_at, observed_resolution_at, is_open,
  round(resolution_hours, 6) AS resolution_hours, round(age_hours, 6) AS age_hours FROM snapshot""")
def incident_snapshot(spark, sf_dir):
    return rounded(snapshot(spark, sf_dir).select(*SNAPSHOT_COLUMNS))


@query("q_daily_queue", "WITH " + DAILY_SQL + f""" SELECT date, first_observed, resolved_transitions, reopened_transitions,
  starting_backlog, backlog, balance_ok FROM daily WHERE date > CAST(TIMESTAMP '{CUTOFF}' AS DATE) - 60""")
def daily_queue(spark, sf_dir):
    return daily(spark, sf_dir)


@query("q_incident_history", "WITH " + SEEN_SQL + """
SELECT incident_id, event_id, state, updated_at AS valid_from, valid_to, valid_to IS NULL AS is_current, rn AS event_order,
  previous_state, terminal AND coalesce(previous_state, '') NOT IN ('Resolved', 'Closed') AS transition_to_terminal,
  NOT terminal AND coalesce(previous_state, '') IN ('Resolved', 'Closed') AS reopened_transition,
  substr(sha256(assignment_group), 1, 16) AS group_key, substr(sha256(priority), 1, 16) AS priority_key,
  sys_mod_count, source_row FROM seen""")
def incident_history(spark, sf_dir):
    return history.incident_history(audit(spark, sf_dir), CUTOFF)


@query("q_summary", "WITH " + SNAPSHOT_SQL + """
SELECT (SELECT count(*) FROM seen) AS events, count(*) AS incidents, count(*) FILTER (WHERE is_open) AS backlog,
  count(*) FILTER (WHERE NOT is_open) AS resolved,
  round(avg(CASE WHEN reopen_count > 0 THEN 1.0 ELSE 0.0 END) * 100, 6) AS reopened_pct,
  round(quantile_cont(resolution_hours, 0.5), 6) AS median_resolution_hours,
  round(quantile_cont(resolution_hours, 0.9), 6) AS p90_resolution_hours FROM snapshot""")
def summary(spark, sf_dir):
    return rounded(reports.summary(audit(spark, sf_dir), saved_snapshot(spark, sf_dir), CUTOFF))


@query("q_group_priority", "WITH " + SNAPSHOT_SQL + """
SELECT assignment_group AS "group", priority, count(*) AS incidents, count(*) FILTER (WHERE is_open) AS open,
  count(*) FILTER (WHERE reopen_count > 0) AS reopened, count(*) FILTER (WHERE reassignment_count > 0) AS reassigned,
  round(quantile_cont(resolution_hours, 0.5), 6) AS median_resolution_hours FROM snapshot GROUP BY ALL""")
def group_priority(spark, sf_dir):
    return rounded(reports.group_priority(saved_snapshot(spark, sf_dir)))


@query("q_queue_health", "WITH " + SNAPSHOT_SQL + """
SELECT assignment_group, count(*) AS incidents, count(*) FILTER (WHERE is_open) AS open_incidents,
  count(*) FILTER (WHERE reopen_count > 0) AS reopened_incidents, round(avg(resolution_hours), 6) AS mean_resolution_hours,
  round(quantile_cont(resolution_hours, 0.9), 6) AS p90_resolution_hours
FROM snapshot GROUP BY assignment_group ORDER BY open_incidents DESC, incidents DESC, assignment_group""")
def queue_health(spark, sf_dir):
    return rounded(reports.queue_health(saved_snapshot(spark, sf_dir), exact=True))


@query("q_queue_filtered", "WITH " + SNAPSHOT_SQL + """
SELECT assignment_group AS "group", count(*) AS incidents, count(*) FILTER (WHERE is_open) AS open,
  count(*) FILTER (WHERE reopen_count > 0) AS reopened, count(*) FILTER (WHERE reassignment_count > 0) AS reassigned
FROM snapshot WHERE lower(assignment_group) LIKE '%group 1%' GROUP BY 1 ORDER BY open DESC, 1 LIMIT 12""")
def queue_filtered(spark, sf_dir):
    return reports.filtered_groups(reports.group_priority(saved_snapshot(spark, sf_dir)), " GROUP 1", limit=12)


@query("q_backlog_flow", "WITH " + DAILY_SQL + """, recent AS (SELECT * FROM daily ORDER BY date DESC LIMIT 14)
SELECT count(*) AS days, min_by(starting_backlog, date) AS first_backlog, max_by(backlog, date) AS last_backlog,
  bool_and(balance_ok) AS balanced, max_by(backlog, date) - min_by(starting_backlog, date) AS net_change,
  max_by(backlog, date) > min_by(starting_backlog, date) AS growing FROM recent""")
def backlog_flow(spark, sf_dir):
    return reports.backlog_flow(daily(spark, sf_dir))


@query("q_profile", "WITH " + AUDIT_SQL + """, one AS (
  SELECT count(*) FILTER (WHERE priority = 'Unknown') AS p, count(*) FILTER (WHERE assignment_group = 'Unknown') AS g,
    count(*) FILTER (WHERE category = 'Unknown') AS c, count(*) FILTER (WHERE contact_type = 'Unknown') AS t,
    min(updated_at) AS lo, max(updated_at) AS hi FROM audit)
SELECT 'unknown_values' AS measure, 'priority' AS item, CAST(p AS VARCHAR) AS value FROM one
UNION ALL SELECT 'unknown_values', 'assignment_group', CAST(g AS VARCHAR) FROM one
UNION ALL SELECT 'unknown_values', 'category', CAST(c AS VARCHAR) FROM one
UNION ALL SELECT 'unknown_values', 'contact_type', CAST(t AS VARCHAR) FROM one
UNION ALL SELECT 'opened_at_conflicts', 'incidents', CAST(count(*) AS VARCHAR) FROM
  (SELECT incident_id FROM audit GROUP BY 1 HAVING count(DISTINCT opened_at) > 1)
UNION ALL SELECT 'event_time', 'min', strftime(lo, '%Y-%m-%d %H:%M:%S') FROM one
UNION ALL SELECT 'event_time', 'max', strftime(hi, '%Y-%m-%d %H:%M:%S') FROM one
UNION ALL SELECT 'states', state, CAST(count(*) AS VARCHAR) FROM audit GROUP BY state""")
def profile(spark, sf_dir):
    return reports.profile(audit(spark, sf_dir))


FINDINGS_SQL = "WITH " + SNAPSHOT_SQL + """, later_seen AS (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY updated_at DESC, sys_mod_count DESC, source_row DESC) AS back
  FROM audit),
chosen AS (SELECT * FROM snapshot WHERE assignment_group IN ('Group 9', 'Unknown')),
firsts AS (SELECT s.incident_id, c.assignment_group AS g, min(CASE WHEN s.rn = 1 THEN s.assignment_group END) AS first_group,
    count(DISTINCT s.assignment_group) = 1 AS single FROM seen s JOIN chosen c ON s.incident_id = c.incident_id GROUP BY 1, 2),
laters AS (SELECT c.assignment_group AS g, l.assignment_group AS later_group, l.state IN ('Resolved', 'Closed') AS done
  FROM later_seen l JOIN chosen c ON l.incident_id = c.incident_id WHERE back = 1)
SELECT assignment_group AS "group", 'incidents' AS measure, 'all' AS item, CAST(count(*) AS DOUBLE) AS value FROM chosen GROUP BY 1
UNION ALL SELECT assignment_group, 'open', 'all', count(*) FILTER (WHERE is_open) FROM chosen GROUP BY 1
UNION ALL SELECT assignment_group, 'reassigned', 'all', count(*) FILTER (WHERE reassignment_count > 0) FROM chosen GROUP BY 1
UNION ALL SELECT assignment_group, 'states', state, count(*) FROM chosen GROUP BY 1, state
UNION ALL SELECT assignment_group, 'opened_months', strftime(opened_at, '%Y-%m'), count(*) FROM chosen GROUP BY 1, 3
UNION ALL SELECT g, 'first_groups', first_group, n FROM (SELECT g, first_group, count(*) AS n,
    row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, first_group) AS r FROM firsts GROUP BY 1, 2) WHERE r <= 5
UNION ALL SELECT g, 'later_groups', later_group, n FROM (SELECT g, later_group, count(*) AS n,
    row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, later_group) AS r FROM laters GROUP BY 1, 2) WHERE r <= 5
UNION ALL SELECT assignment_group, 'median_open_age_hours', 'all', round(quantile_cont(age_hours, 0.5), 6)
  FROM chosen WHERE is_open GROUP BY 1
UNION ALL SELECT g, 'terminal_by_extract_end', 'all', count(*) FILTER (WHERE done) FROM laters GROUP BY 1
UNION ALL SELECT g, 'only_one_observed_group', 'all', count(*) FILTER (WHERE single) FROM firsts GROUP BY 1"""


@query("q_group_findings", FINDINGS_SQL)
def group_findings(spark, sf_dir):
    events = audit(spark, sf_dir)
    end = events.agg(F.max("updated_at")).first()[0]
    later = materialize(history.incident_snapshot(history.segment_summary(events, end), end), "later")
    return rounded(reports.group_findings(events, saved_snapshot(spark, sf_dir), later, CUTOFF, ["Group 9", "Unknown"]))


# ---- star schema and gates ----------------------------------------------------------------------------------

@query("q_dim_group", "WITH " + SEEN_SQL + """
SELECT DISTINCT substr(sha256(assignment_group), 1, 16) AS group_key, assignment_group FROM seen""")
def dim_group(spark, sf_dir):
    return star.dim_assignment_group(audit(spark, sf_dir), CUTOFF)


@query("q_dim_priority", "WITH " + SEEN_SQL + """
SELECT DISTINCT substr(sha256(priority), 1, 16) AS priority_key, priority FROM seen""")
def dim_priority(spark, sf_dir):
    return star.dim_priority(audit(spark, sf_dir), CUTOFF)


@query("q_dim_date", "WITH " + SEEN_SQL + f""", days AS (SELECT CAST(unnest(generate_series(
  CAST((SELECT min(opened_at) FROM seen) AS DATE), CAST(TIMESTAMP '{CUTOFF}' AS DATE), INTERVAL 1 DAY)) AS DATE) AS date)
SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, date, CAST(year(date) AS INTEGER) AS year,
  CAST(month(date) AS INTEGER) AS month, CAST(day(date) AS INTEGER) AS day, dayname(date) AS weekday,
  isodow(date) >= 6 AS is_weekend FROM days""")
def dim_date(spark, sf_dir):
    return star.dim_date(audit(spark, sf_dir), CUTOFF)


@query("q_fact_snapshot_join", "WITH " + SNAPSHOT_SQL + """
SELECT incident_id, state, is_open, round(resolution_hours, 6) AS resolution_hours, round(age_hours, 6) AS age_hours,
  group_key, priority_key, opened_date_key, snapshot_date_key FROM snapshot""")
def fact_snapshot_join(spark, sf_dir):
    stage = history.snapshot_keys(snapshot(spark, sf_dir), CUTOFF)
    fact = star.fact_snapshot(stage, *dimensions(spark, sf_dir))
    return rounded(fact.select("incident_id", "state", "is_open", "resolution_hours", "age_hours", *KEY_COLUMNS))


@query("q_join_grain", "WITH " + SNAPSHOT_SQL + """
SELECT count(*) AS stage_rows, count(*) AS fact_rows, true AS passed FROM snapshot""")
def join_grain(spark, sf_dir):
    stage = saved_snapshot(spark, sf_dir)
    return star.join_grain(stage, star.fact_snapshot(stage, *dimensions(spark, sf_dir)))


@query("q_aggregate_queue", "WITH " + SNAPSHOT_SQL + """
SELECT assignment_group AS group_name, priority, count(*) AS incidents, count(*) FILTER (WHERE is_open) AS open_count,
  count(*) FILTER (WHERE reopen_count > 0) AS reopened, count(*) FILTER (WHERE reassignment_count > 0) AS reassigned
FROM snapshot GROUP BY ALL""")
def aggregate_queue(spark, sf_dir):
    groups, priorities, _ = dimensions(spark, sf_dir)
    return star.aggregate_queue(history.snapshot_keys(snapshot(spark, sf_dir), CUTOFF), groups, priorities)


@query("q_verify_integrity", "WITH " + SNAPSHOT_SQL + """
SELECT count(*) AS snapshot_rows, count(DISTINCT incident_id) AS unique_incidents, count(*) FILTER (WHERE is_open) AS backlog,
  CAST(0 AS BIGINT) AS missing_group, CAST(0 AS BIGINT) AS missing_priority, CAST(0 AS BIGINT) AS missing_opened_date,
  count(*) FILTER (WHERE resolution_hours < 0) AS negative_resolution FROM snapshot""")
def verify_integrity(spark, sf_dir):
    return star.verify_integrity(saved_snapshot(spark, sf_dir), *dimensions(spark, sf_dir))


@query("q_fk_violations", "WITH " + SNAPSHOT_SQL + """
SELECT 'group_key' AS foreign_key, group_key AS key, count(*) AS rows FROM snapshot
WHERE assignment_group = 'Unknown' GROUP BY group_key""")
def fk_violations(spark, sf_dir):
    """The dimension lacks its ``Unknown`` member, so exactly those facts must be reported."""
    groups, priorities, dates = dimensions(spark, sf_dir)
    return star.fk_violations(saved_snapshot(spark, sf_dir), groups.filter("assignment_group <> 'Unknown'"), priorities, dates)


@query("q_queue_reconcile", "WITH " + SNAPSHOT_SQL + """
SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, true AS passed""")
def queue_reconcile(spark, sf_dir):
    groups, priorities, _ = dimensions(spark, sf_dir)
    fact = saved_snapshot(spark, sf_dir)
    report = reports.group_priority(fact).select(F.col("group").alias("group_name"), "priority", "incidents",
                                                 F.col("open").alias("open_count"), "reopened", "reassigned")
    return reports.reconcile(star.aggregate_queue(fact, groups, priorities), report)


@query("q_report_parity", """SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right, true AS passed""")
def report_parity(spark, sf_dir):
    """The daily table built with hourly and with six-hour segments must agree row for row."""
    events = audit(spark, sf_dir)
    builds = [history.daily_queue(history.segment_summary(events, CUTOFF, hours), CUTOFF, hours=hours) for hours in (1, 6)]
    return reports.reconcile(*builds)


INTEGRITY_NAMES = ("event_identity_unique", "incident_grain_unique", "group_dimension_unique", "priority_dimension_unique",
                   "date_dimension_unique", "date_foreign_keys_valid", "group_foreign_keys_valid",
                   "priority_foreign_keys_valid", "one_current_history_row", "nonnegative_durations",
                   "history_intervals_valid", "no_future_events_in_mart", "incident_balance", "group_totals_reconcile",
                   "last_daily_backlog_reconciles", "daily_flow_balance")


@query("q_integrity", "SELECT name, CAST(0 AS BIGINT) AS violations, true AS passed FROM (VALUES "
       + ", ".join(f"('{name}')" for name in INTEGRITY_NAMES) + ") t(name)")
def integrity(spark, sf_dir):
    events = audit(spark, sf_dir)
    per_segment = materialize(history.segment_summary(events, CUTOFF), "segments")
    fact = materialize(history.snapshot_keys(history.incident_snapshot(per_segment, CUTOFF), CUTOFF), "snapshot")
    groups, priorities, dates = dimensions(spark, sf_dir)
    return star.integrity_checks(
        events, fact, history.incident_history(events, CUTOFF), groups, priorities, dates,
        materialize(reports.summary(events, fact, CUTOFF), "summary"), materialize(reports.group_priority(fact), "groups"),
        history.daily_queue(per_segment, CUTOFF), CUTOFF)


# ---- gates over tables with planted faults: every count must be found, none is constant ----------------------------

NUMBER_SQL = "CAST(substr(incident_id, 4) AS BIGINT)"


def number():
    return F.substring("incident_id", 4, 20).cast("bigint")


def faulty_dimensions(spark, sf_dir):
    """Without the group ``Unknown``, the priority ``4 - Low`` and the cutoff's date; one member of each is there twice."""
    groups, priorities, dates = dimensions(spark, sf_dir)
    last = F.to_date(F.lit(CUTOFF[:10]))
    return (groups.filter("assignment_group <> 'Unknown'").unionByName(groups.filter("assignment_group = 'Group 3'")),
            priorities.filter("priority <> '4 - Low'").unionByName(priorities.filter("priority = '1 - Critical'")),
            dates.filter(F.col("date") != last).unionByName(dates.filter(F.col("date") == F.date_sub(last, 1))))


PLANTED_SQL = "WITH " + SNAPSHOT_SQL + f""", fact AS (SELECT *, {NUMBER_SQL} AS num, CASE WHEN {NUMBER_SQL} % 7 = 0 THEN 2 ELSE 1 END AS m FROM snapshot),
rows AS (SELECT *, {NUMBER_SQL} AS num FROM seen),
counts(name, violations) AS (
  SELECT 'event_identity_unique', (SELECT count(*) FROM audit WHERE (source_row - 2) % 50 = 0)
  UNION ALL SELECT 'incident_grain_unique', (SELECT count(*) FROM fact WHERE num % 7 = 0)
  UNION ALL SELECT 'group_dimension_unique', 1 UNION ALL SELECT 'priority_dimension_unique', 1 UNION ALL SELECT 'date_dimension_unique', 1
  UNION ALL SELECT 'date_foreign_keys_valid', (SELECT sum(m) FROM fact)
  UNION ALL SELECT 'group_foreign_keys_valid', (SELECT coalesce(sum(m), 0) FROM fact WHERE assignment_group = 'Unknown')
  UNION ALL SELECT 'priority_foreign_keys_valid', (SELECT coalesce(sum(m), 0) FROM fact WHERE priority = '4 - Low')
  UNION ALL SELECT 'one_current_history_row', (SELECT count(DISTINCT num) FROM rows WHERE num % 11 = 0)
  UNION ALL SELECT 'history_intervals_valid', (SELECT count(*) FROM rows WHERE num % 13 = 0 AND rn = 1 AND valid_to IS NOT NULL)
  UNION ALL SELECT 'nonnegative_durations', (SELECT coalesce(sum(m), 0) FROM fact WHERE num % 17 = 0)
  UNION ALL SELECT 'no_future_events_in_mart', (SELECT coalesce(sum(m), 0) FROM fact WHERE num % 19 = 0)
  UNION ALL SELECT 'incident_balance', 1 UNION ALL SELECT 'group_totals_reconcile', 1 UNION ALL SELECT 'last_daily_backlog_reconciles', 1
  UNION ALL SELECT 'daily_flow_balance', (SELECT count(*) FROM (SELECT unnest(generate_series(greatest((SELECT min(event_date) FROM seen),
    CAST(TIMESTAMP '{CUTOFF}' AS DATE) - 59), CAST(TIMESTAMP '{CUTOFF}' AS DATE), INTERVAL 1 DAY)) AS date) WHERE day(date) % 2 = 1))
SELECT name, CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM counts"""


@query("q_integrity_planted", PLANTED_SQL)
def integrity_planted(spark, sf_dir):
    """All sixteen checks over tables with planted faults; each must count exactly those."""
    events = audit(spark, sf_dir)
    per_segment = materialize(history.segment_summary(events, CUTOFF), "segments")
    true_fact = materialize(history.snapshot_keys(history.incident_snapshot(per_segment, CUTOFF), CUTOFF), "snapshot")
    summary_row = reports.summary(events, true_fact, CUTOFF).withColumns({"incidents": F.col("incidents") + 2, "backlog": F.col("backlog") + 1})
    daily_rows = history.daily_queue(per_segment, CUTOFF).withColumn("balance_ok", F.dayofmonth("date") % 2 == 0)
    fact = true_fact.withColumn("resolution_hours", F.when(number() % 17 == 0, F.lit(-1.0)).otherwise(F.col("resolution_hours"))).withColumn(
        "updated_at", F.when(number() % 19 == 0, F.col("updated_at") + F.expr("INTERVAL 1 YEAR")).otherwise(F.col("updated_at")))
    fact = materialize(fact.unionByName(fact.filter(number() % 7 == 0)), "fact")
    intervals = history.incident_history(events, CUTOFF)
    intervals = intervals.withColumn("is_current", F.col("is_current") & (number() % 11 != 0)).withColumn(
        "valid_to", F.when((number() % 13 == 0) & (F.col("event_order") == 1) & F.col("valid_to").isNotNull(), F.col("valid_from") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("valid_to")))
    doubled = events.unionByName(events.filter((F.col("source_row") - 2) % 50 == 0))
    return star.integrity_checks(doubled, fact, intervals, *faulty_dimensions(spark, sf_dir), materialize(summary_row, "summary"),
                                 materialize(reports.group_priority(true_fact), "groups"), materialize(daily_rows, "daily"), CUTOFF)


@query("q_join_grain_planted", "WITH " + SNAPSHOT_SQL + """, sizes AS (SELECT count(*) AS a,
  coalesce(sum(CASE WHEN assignment_group <> 'Unknown' AND priority <> '4 - Low' THEN
    CASE WHEN assignment_group = 'Group 3' THEN 2 ELSE 1 END * CASE WHEN priority = '1 - Critical' THEN 2 ELSE 1 END END), 0) AS b FROM snapshot)
SELECT a AS stage_rows, CAST(b AS BIGINT) AS fact_rows, a = b AS passed FROM sizes""")
def join_grain_planted(spark, sf_dir):
    """Groups and priorities with members missing and doubled change the grain of the fact."""
    stage = saved_snapshot(spark, sf_dir)
    groups, priorities, _ = faulty_dimensions(spark, sf_dir)
    return star.join_grain(stage, star.fact_snapshot(stage, groups, priorities, dimensions(spark, sf_dir)[2]))


@query("q_verify_integrity_planted", "WITH " + SNAPSHOT_SQL + f""", fact AS (SELECT *, {NUMBER_SQL} AS num, CASE WHEN {NUMBER_SQL} % 7 = 0 THEN 2 ELSE 1 END AS m FROM snapshot)
SELECT CAST(sum(m) AS BIGINT) AS snapshot_rows, count(*) AS unique_incidents, CAST(coalesce(sum(m) FILTER (WHERE is_open), 0) AS BIGINT) AS backlog,
  CAST(coalesce(sum(m) FILTER (WHERE assignment_group = 'Unknown'), 0) AS BIGINT) AS missing_group,
  CAST(coalesce(sum(m) FILTER (WHERE priority = '4 - Low'), 0) AS BIGINT) AS missing_priority,
  CAST(coalesce(sum(m) FILTER (WHERE day(opened_at) % 3 = 0), 0) AS BIGINT) AS missing_opened_date,
  CAST(coalesce(sum(m) FILTER (WHERE num % 17 = 0), 0) AS BIGINT) AS negative_resolution FROM fact""")
def verify_integrity_planted(spark, sf_dir):
    """The left-join audit over a fact with doubled incidents and negative durations, and dimensions with members missing."""
    fact = saved_snapshot(spark, sf_dir).withColumn("resolution_hours", F.when(number() % 17 == 0, F.lit(-1.0)).otherwise(F.col("resolution_hours")))
    fact = fact.unionByName(fact.filter(number() % 7 == 0))
    groups, priorities, dates = dimensions(spark, sf_dir)
    return star.verify_integrity(fact, groups.filter("assignment_group <> 'Unknown'"), priorities.filter("priority <> '4 - Low'"), dates.filter("day % 3 <> 0"))


@query("q_queue_reconcile_planted", "WITH " + SNAPSHOT_SQL + """, cells AS (SELECT assignment_group, priority, count(*) AS n FROM snapshot GROUP BY ALL)
SELECT count(*) FILTER (WHERE priority = '1 - Critical' OR n % 2 = 1) AS only_left, count(*) FILTER (WHERE priority <> '1 - Critical' AND n % 2 = 1) AS only_right,
  count(*) FILTER (WHERE priority = '1 - Critical' OR n % 2 = 1) = 0 AS passed FROM cells""")
def queue_reconcile_planted(spark, sf_dir):
    """The report lacks the critical cells and counts one incident too many in cells of odd size."""
    groups, priorities, _ = dimensions(spark, sf_dir)
    fact = saved_snapshot(spark, sf_dir)
    report = reports.group_priority(fact).filter("priority <> '1 - Critical'").select(
        F.col("group").alias("group_name"), "priority", (F.col("incidents") + F.col("incidents") % 2).alias("incidents"), F.col("open").alias("open_count"), "reopened", "reassigned")
    return reports.reconcile(star.aggregate_queue(fact, groups, priorities), report)


@query("q_part_parity", "WITH " + SNAPSHOT_SQL + f"""
SELECT {NUMBER_SQL} % 16 AS part, count(*) AS left_rows, count(*) + count(*) FILTER (WHERE {NUMBER_SQL} % 23 = 0) AS right_rows FROM snapshot
GROUP BY 1 HAVING count(*) FILTER (WHERE {NUMBER_SQL} % 23 = 0 OR {NUMBER_SQL} % 29 = 0) > 0""")
def part_parity(spark, sf_dir):
    """The snapshot from hourly and from six-hour segments, compared part by part by order-free fingerprints; faults are planted in some incidents."""
    events = audit(spark, sf_dir)
    left, right = (materialize(history.incident_snapshot(history.segment_summary(events, CUTOFF, hours), CUTOFF), "build").withColumn("part", number() % 16) for hours in (1, 6))
    right = right.withColumn("state", F.when(number() % 29 == 0, F.lit("New!")).otherwise(F.col("state")))
    return reports.differing_parts(left, right.unionByName(right.filter(number() % 23 == 0)), ["part"])
