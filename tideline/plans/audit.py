"""Inputs of the incident jobs, derived row by row from the given tables (no shuffle, no sampling)."""
from pyspark.sql import functions as F

from tideline.functions.text import clean_text
from tideline.operators.normalize import validate_rows
from tideline.session import read_table

CUTOFF = "2024-01-20 12:00:00"


def audit_columns(events):
    """``events`` rows read as audit observations: the user is the incident."""
    k = F.get_json_object("props", "$.k").cast("int")
    group = F.when(k % 12 == 0, F.lit("?")).otherwise(F.concat(F.lit("Group "), (k % 12).cast("string")))
    state = (F.when(F.col("event_type") == "signup", "New").when(F.col("event_type") == "view", "Active")
             .when(F.col("event_type") == "click", "Awaiting User Info")
             .when(F.col("event_type") == "purchase", "Resolved").otherwise("Closed"))
    priority = (F.when(F.col("value") >= 100, "1 - Critical").when(F.col("value") >= 50, "2 - High")
                .when(F.col("value") >= 20, "3 - Moderate").otherwise("4 - Low"))
    contact = (F.when(F.col("event_id") % 3 == 0, "Phone").when(F.col("event_id") % 3 == 1, "Email")
               .otherwise("Self service"))
    return {
        "source_row": F.col("event_id") + 2, "state": state, "updated_at": F.col("ts"),
        "event_date": F.to_date("ts"), "sys_mod_count": k, "priority": priority,
        "assignment_group": clean_text(group), "category": F.concat(F.lit("Category "), (F.col("event_id") % 5).cast("string")),
        "contact_type": contact, "reopen_count": F.when(k % 7 == 0, 1).otherwise(0), "reassignment_count": k % 4,
    }


def audit(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    columns = audit_columns(events)
    return events.select(
        F.sha2(F.concat(F.lit("events:"), columns["source_row"].cast("string")), 256).alias("event_id"),
        F.concat(F.lit("INC"), F.col("user_id").cast("string")).alias("incident_id"),
        F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' - make_dt_interval(0, cast(user_id % 240 as int))").alias("opened_at"),
        *[column.alias(name) for name, column in columns.items()])


AUDIT_SQL = """audit AS (
  SELECT sha256('events:' || CAST(event_id + 2 AS VARCHAR)) AS event_id, 'INC' || CAST(user_id AS VARCHAR) AS incident_id,
    TIMESTAMP '2024-01-01 00:00:00' - to_hours(CAST(user_id % 240 AS INTEGER)) AS opened_at,
    event_id + 2 AS source_row,
    CASE event_type WHEN 'signup' THEN 'New' WHEN 'view' THEN 'Active' WHEN 'click' THEN 'Awaiting User Info'
      WHEN 'purchase' THEN 'Resolved' ELSE 'Closed' END AS state,
    ts AS updated_at, CAST(ts AS DATE) AS event_date, k AS sys_mod_count,
    CASE WHEN value >= 100 THEN '1 - Critical' WHEN value >= 50 THEN '2 - High'
      WHEN value >= 20 THEN '3 - Moderate' ELSE '4 - Low' END AS priority,
    CASE WHEN k % 12 = 0 THEN 'Unknown' ELSE 'Group ' || CAST(k % 12 AS VARCHAR) END AS assignment_group,
    'Category ' || CAST(event_id % 5 AS VARCHAR) AS category,
    CASE event_id % 3 WHEN 0 THEN 'Phone' WHEN 1 THEN 'Email' ELSE 'Self service' END AS contact_type,
    CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS reopen_count, k % 4 AS reassignment_count
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

SEEN_SQL = AUDIT_SQL + f""", seen AS (
  SELECT *, row_number() OVER w AS rn, lag(state) OVER w AS previous_state, lead(updated_at) OVER w AS valid_to,
    state IN ('Resolved', 'Closed') AS terminal
  FROM audit WHERE updated_at <= TIMESTAMP '{CUTOFF}'
  WINDOW w AS (PARTITION BY incident_id ORDER BY updated_at, sys_mod_count, source_row))"""

SNAPSHOT_SQL = SEEN_SQL + f""", edges AS (
  SELECT incident_id, max(rn) AS n, coalesce(max(CASE WHEN NOT terminal THEN rn END), -1) AS last_open,
    min(updated_at) AS first_observed_at FROM seen GROUP BY incident_id),
cycle AS (
  SELECT s.incident_id, max(CASE WHEN state = 'Resolved' THEN updated_at END) AS resolved_at, min(updated_at) AS closed_at
  FROM seen s JOIN edges e ON s.incident_id = e.incident_id AND s.terminal AND s.rn > e.last_open GROUP BY s.incident_id),
snapshot AS (
  SELECT s.*, e.first_observed_at, NOT s.terminal AS is_open,
    CASE WHEN s.terminal THEN coalesce(c.resolved_at, c.closed_at) END AS observed_resolution_at,
    CASE WHEN s.terminal THEN date_diff('microsecond', s.opened_at, coalesce(c.resolved_at, c.closed_at)) / 3.6e9 END
      AS resolution_hours,
    date_diff('microsecond', s.opened_at, TIMESTAMP '{CUTOFF}') / 3.6e9 AS age_hours,
    substr(sha256(s.assignment_group), 1, 16) AS group_key, substr(sha256(s.priority), 1, 16) AS priority_key,
    CAST(strftime(s.opened_at, '%Y%m%d') AS INTEGER) AS opened_date_key,
    CAST(strftime(TIMESTAMP '{CUTOFF}', '%Y%m%d') AS INTEGER) AS snapshot_date_key
  FROM seen s JOIN edges e ON s.incident_id = e.incident_id AND s.rn = e.n
  LEFT JOIN cycle c ON c.incident_id = s.incident_id)"""

DAILY_SQL = SEEN_SQL + f""", flows AS (
  SELECT event_date AS date, count(*) FILTER (WHERE previous_state IS NULL) AS first_observed,
    count(*) FILTER (WHERE terminal AND coalesce(previous_state, '') NOT IN ('Resolved', 'Closed')) AS resolved_transitions,
    count(*) FILTER (WHERE NOT terminal AND previous_state IN ('Resolved', 'Closed')) AS reopened_transitions
  FROM seen GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series((SELECT min(event_date) FROM seen), CAST(TIMESTAMP '{CUTOFF}' AS DATE),
  INTERVAL 1 DAY)) AS DATE) AS date),
dense AS (
  SELECT s.date, coalesce(first_observed, 0) AS first_observed, coalesce(resolved_transitions, 0) AS resolved_transitions,
    coalesce(reopened_transitions, 0) AS reopened_transitions FROM spine s LEFT JOIN flows f ON s.date = f.date),
daily AS (
  SELECT *, CAST(sum(first_observed - resolved_transitions + reopened_transitions) OVER (ORDER BY date) AS BIGINT) AS backlog,
    CAST(coalesce(sum(first_observed - resolved_transitions + reopened_transitions)
      OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS starting_backlog,
    true AS balance_ok FROM dense)"""


# ---- raw text rows, with defects that depend on the row alone ----------------------------------------------

RAW_SOURCE = "0f" * 32


def raw_rows(spark, sf_dir):
    """Every event as a row of source text; residues of the row number plant one defect each."""
    events = read_table(spark, sf_dir, "events")
    n, columns = F.col("event_id"), audit_columns(events)
    text = {
        "number": F.when(n % 97 == 5, F.lit(" ? ")).when(n % 101 == 7, F.concat(F.lit("REQ"), F.col("user_id").cast("string")))
        .otherwise(F.concat(F.lit(" INC"), F.col("user_id").cast("string"), F.lit("\t"))),
        "incident_state": F.when(n % 103 == 11, F.lit("-100")).otherwise(F.concat(columns["state"], F.lit(" "))),
        "opened_at": F.when(n % 107 == 13, F.lit("31/02/2024 10:00")).when(n % 109 == 17, F.lit(""))
        .otherwise(F.date_format(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00' - make_dt_interval(0, cast(user_id % 240 as int))"),
                                 "d/M/yyyy HH:mm")),
        "sys_updated_at": F.when(n % 113 == 19, F.lit("1/1/2016 9:5")).otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm")),
        "sys_mod_count": F.when(n % 127 == 23, F.lit("-4")).otherwise(columns["sys_mod_count"].cast("string")),
        "priority": columns["priority"],
        "assignment_group": F.when(columns["sys_mod_count"] % 12 == 0, F.lit("?")).otherwise(columns["assignment_group"]),
        "category": F.when(n % 5 == 0, F.lit("   ")).otherwise(columns["category"]),
        "contact_type": columns["contact_type"],
        "reopen_count": F.when(n % 131 == 29, F.lit("1.5")).otherwise(columns["reopen_count"].cast("string")),
        "reassignment_count": columns["reassignment_count"].cast("string"),
        "resolved_at": F.date_format("ts", "dd/MM/yyyy HH:mm"),
    }
    return events.select(F.lit(RAW_SOURCE).alias("source_sha256"), (n + 2).alias("source_row"),
                         *[column.alias(name) for name, column in text.items()])


def checked_rows(spark, sf_dir):
    return validate_rows(raw_rows(spark, sf_dir))


CHECKED_SQL = AUDIT_SQL + """, text AS (
  SELECT a.*, e.event_id AS n, e.user_id,
    e.event_id % 97 = 5 AS no_id, e.event_id % 101 = 7 AND e.event_id % 97 <> 5 AS bad_id, e.event_id % 103 = 11 AS bad_state,
    e.event_id % 107 = 13 AS bad_open, e.event_id % 109 = 17 AND e.event_id % 107 <> 13 AS no_open,
    e.event_id % 113 = 19 AS early, e.event_id % 127 = 23 AS negative, e.event_id % 131 = 29 AS fraction,
    date_trunc('minute', a.updated_at) AS updated_minute
  FROM audit a JOIN events e ON a.source_row = e.event_id + 2),
checked AS (
  SELECT *, concat_ws(',',
    CASE WHEN no_id THEN 'missing_incident_id' WHEN bad_id THEN 'invalid_incident_id' END,
    CASE WHEN bad_state THEN 'unknown_state' END,
    CASE WHEN bad_open THEN 'invalid_opened_at' WHEN no_open THEN 'missing_opened_at' END,
    CASE WHEN early AND NOT bad_open AND NOT no_open THEN 'update_before_open' END,
    CASE WHEN negative THEN 'negative_sys_mod_count,invalid_sys_mod_count' END,
    CASE WHEN fraction THEN 'invalid_reopen_count' END) AS errors,
    CASE WHEN n % 5 = 0 THEN 'Unknown' ELSE category END AS clean_category,
    CASE WHEN early THEN TIMESTAMP '2016-01-01 09:05:00' ELSE updated_minute END AS parsed_update
  FROM text)"""
