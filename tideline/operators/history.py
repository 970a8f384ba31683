"""Point-in-time state of incidents from their audit events.

Every result starts from ``segment_events``: events of one incident in one segment (an hour by default),
ordered by (updated_at, sys_mod_count, source_row, event_id). Segments are summarised to one row each before
anything is grouped by incident, so a hot incident is spread over the cluster by time and the per-incident
pass sees at most one row per segment of the calendar.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.text import dimension_key
from tideline.functions.timecols import date_key, hours_between, ntz
from tideline.operators.normalize import is_terminal

ORDER = ("updated_at", "sys_mod_count", "source_row", "event_id")
ATTRIBUTES = ("event_id", "source_row", "state", "opened_at", "updated_at", "sys_mod_count", "priority",
              "assignment_group", "category", "contact_type", "reopen_count", "reassignment_count")


def visible_events(events, cutoff):
    """As-of filter. Both predicates reach the scan; ``event_date`` prunes partitions of the event table."""
    seen = events.filter(F.col("updated_at") <= ntz(cutoff))
    if "event_date" in events.columns:
        seen = seen.filter(F.col("event_date") <= F.to_date(F.lit(str(cutoff)[:10])))
    return seen


def require_visible(events, cutoff):
    if visible_events(events, cutoff).isEmpty():
        raise ValueError("No event is visible at the cutoff")


def segment_events(events, cutoff, hours=1):
    """Visible events with their position, previous state and next time inside (incident, segment)."""
    if 24 % hours:
        raise ValueError("Segments must divide a day")
    day = F.date_diff(F.to_date("updated_at"), F.lit("1970-01-01").cast("date"))
    seen = visible_events(events, cutoff).withColumn("segment", day * (24 // hours) + F.floor(F.hour("updated_at") / hours))
    window = Window.partitionBy("incident_id", "segment").orderBy(*ORDER)
    return (seen.withColumn("position", F.row_number().over(window))
            .withColumn("before_state", F.lag("state").over(window))
            .withColumn("next_at", F.lead("updated_at").over(window)))


def segment_summary(events, cutoff, hours=1):
    """One row per (incident, segment): edge states, counts of inner transitions, last relevant positions.

    Everything comes from one sort inside segments: measures are taken over the whole segment, and its last row stays with its payload.
    """
    rows = segment_events(events, cutoff, hours)
    terminal, was_terminal = is_terminal(F.col("state")), is_terminal(F.col("before_state"))
    inner_entry = F.col("before_state").isNotNull() & terminal & ~was_terminal
    inner_reopen = F.col("before_state").isNotNull() & ~terminal & was_terminal
    resolved = F.col("state") == "Resolved"
    ordered = Window.partitionBy("incident_id", "segment").orderBy(*ORDER)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    measures = {
        "events": F.count("*"), "first_at": F.first("updated_at"), "last_at": F.last("updated_at"), "first_state": F.first("state"),
        "inner_entries": F.count_if(inner_entry), "inner_reopens": F.count_if(inner_reopen), "inner_entry_at": F.max(F.when(inner_entry, F.col("updated_at"))),
        "open_position": F.max(F.when(~terminal, F.col("position"))), "resolved_position": F.max(F.when(resolved, F.col("position"))),
        "resolved_at": F.max(F.when(resolved, F.col("updated_at")))}
    summary = (rows.withColumns({name: measure.over(whole) for name, measure in measures.items()}).filter("next_at IS NULL")
               .select("incident_id", "segment", "events", "first_at", "last_at", "first_state", F.struct(*ATTRIBUTES).alias("last"),
                       *[name for name in measures if name not in ("events", "first_at", "last_at", "first_state")]))
    across = Window.partitionBy("incident_id").orderBy("segment")
    opened_before = F.col("prior_state").isNotNull() & is_terminal(F.col("prior_state"))
    return (summary.withColumn("prior_state", F.lag("last.state").over(across))
            .withColumn("edge_entry", is_terminal(F.col("first_state")) & ~F.coalesce(opened_before, F.lit(False)))
            .withColumn("edge_reopen", ~is_terminal(F.col("first_state")) & opened_before))


def incident_snapshot(summary, cutoff):
    """Latest state per incident with first observation, closing cycle, resolution hours and age.

    Resolution is the last ``Resolved`` of the current closing cycle, else the entry into that cycle. One sort of an incident's segments; its last
    segment stays with its payload.
    """
    entry_at = F.greatest("inner_entry_at", F.when(F.col("edge_entry"), F.col("first_at")))
    place = lambda position: F.col("segment").cast("decimal(20,0)") * F.lit(1 << 32) + F.col(position)
    ordered = Window.partitionBy("incident_id").orderBy("segment")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    measures = {"first_observed_at": F.min("first_at"), "entry_at": F.max(entry_at), "open_order": F.max(place("open_position")),
                "resolved_order": F.max(place("resolved_position")), "resolved_at": F.max("resolved_at")}
    per_incident = (summary.select("*", *[measure.over(whole).alias(f"_{name}") for name, measure in measures.items()],
                                   F.lead("segment").over(ordered).alias("_later")).filter("_later IS NULL"))
    in_cycle = F.col("_resolved_order").isNotNull() & (F.col("_open_order").isNull() | (F.col("_resolved_order") > F.col("_open_order")))
    snapshot = per_incident.select("incident_id", "last.*", F.col("_first_observed_at").alias("first_observed_at"), F.col("_entry_at").alias("entry_at"),
                                   F.col("_resolved_at").alias("resolved_at"), in_cycle.alias("in_cycle"), (~is_terminal(F.col("last.state"))).alias("is_open"))
    closed_at = F.when(~F.col("is_open"),
                       F.when(F.col("in_cycle"), F.col("resolved_at")).otherwise(F.col("entry_at")))
    return (snapshot.withColumn("observed_resolution_at", closed_at)
            .withColumn("resolution_hours", hours_between(F.col("opened_at"), F.col("observed_resolution_at")))
            .withColumn("age_hours", hours_between(F.col("opened_at"), ntz(cutoff)))
            .drop("entry_at", "resolved_at", "in_cycle"))


def snapshot_keys(snapshot, cutoff):
    """Dimension keys of the snapshot fact."""
    return (snapshot.withColumn("group_key", dimension_key(F.col("assignment_group")))
            .withColumn("priority_key", dimension_key(F.col("priority")))
            .withColumn("opened_date_key", date_key(F.col("opened_at")))
            .withColumn("snapshot_date_key", date_key(ntz(cutoff))))


def daily_flows(summary, hours=1, keys=()):
    """Flows per day (and ``keys``) from segments; flows of disjoint sets of incidents add up."""
    epoch = F.lit("1970-01-01").cast("date")
    return (summary.withColumn("date", F.date_add(epoch, F.floor(F.col("segment") / (24 // hours)).cast("int")))
            .groupBy(*keys, "date").agg(
                F.count_if(F.col("prior_state").isNull()).alias("first_observed"),
                F.sum(F.col("inner_entries") + F.col("edge_entry").cast("int")).alias("resolved_transitions"),
                F.sum(F.col("inner_reopens") + F.coalesce(F.col("edge_reopen"), F.lit(False)).cast("int"))
                .alias("reopened_transitions"),
                F.sum(F.when(~is_terminal(F.col("last.state")), 1).otherwise(0)
                      - F.when(F.col("prior_state").isNotNull() & ~is_terminal(F.col("prior_state")), 1).otherwise(0))
                .alias("open_change")))


def daily_queue(summary, cutoff, days=60, hours=1):
    """Daily flows and running backlog; days without events are kept, only the last ``days`` returned."""
    return queue_of_flows(daily_flows(summary, hours), cutoff, days)


def queue_of_flows(flows, cutoff, days=60):
    """The daily queue from flows with one row a day."""
    # One row per calendar day from here on: the spine and the running sums are bounded by the calendar.
    spine = flows.agg(F.min("date").alias("first")).select(
        F.explode(F.sequence("first", F.to_date(F.lit(str(cutoff)[:10])))).alias("date"))
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    daily = (spine.join(flows, "date", "left").na.fill(0)
             .withColumn("backlog", F.sum("open_change").over(upto))
             .withColumn("starting_backlog", F.col("backlog") - F.col("open_change")))
    return (daily.filter(F.col("date") > F.date_sub(F.to_date(F.lit(str(cutoff)[:10])), days))
            .select("date", "first_observed", "resolved_transitions", "reopened_transitions", "starting_backlog",
                    "backlog", (F.col("starting_backlog") + F.col("first_observed") - F.col("resolved_transitions")
                                + F.col("reopened_transitions") == F.col("backlog")).alias("balance_ok")))


def incident_history(events, cutoff, hours=1):
    """Validity intervals per event: lead/lag across segments comes from the segment summaries."""
    rows = segment_events(events, cutoff, hours)
    across = Window.partitionBy("incident_id").orderBy("segment")
    edges = (rows.groupBy("incident_id", "segment").agg(
        F.count("*").alias("n"), F.min("updated_at").alias("first_at"),
        F.max_by("state", "position").alias("last_state"))
        .withColumn("prior_state", F.lag("last_state").over(across))
        .withColumn("following_at", F.lead("first_at").over(across))
        .withColumn("offset", F.coalesce(F.sum("n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("incident_id", "segment", "prior_state", "following_at", "offset"))
    terminal = is_terminal(F.col("state"))
    # A missing previous state counts as "not terminal".
    was_terminal = F.coalesce(is_terminal(F.col("previous_state")), F.lit(False))
    return (rows.join(edges, ["incident_id", "segment"])
            .withColumn("previous_state", F.coalesce("before_state", "prior_state"))
            .withColumn("valid_to", F.coalesce("next_at", "following_at"))
            .select("incident_id", "event_id", "state", F.col("updated_at").alias("valid_from"), "valid_to",
                    F.col("valid_to").isNull().alias("is_current"),
                    (F.col("offset") + F.col("position")).alias("event_order"), "previous_state",
                    (terminal & ~was_terminal).alias("transition_to_terminal"),
                    (~terminal & was_terminal).alias("reopened_transition"),
                    dimension_key(F.col("assignment_group")).alias("group_key"),
                    dimension_key(F.col("priority")).alias("priority_key"), "sys_mod_count", "source_row"))
