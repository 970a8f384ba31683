"""Report tables over the snapshot, the event log and the daily queue."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators.history import ORDER, visible_events
from tideline.operators.normalize import DIMENSIONS
from tideline.operators.quantiles import exact_percentiles
from tideline.functions.text import UNKNOWN

def _closed_hours(snapshot):
    return snapshot.withColumn("closed_hours", F.when(~F.col("is_open"), F.col("resolution_hours")))


def summary(events, snapshot, cutoff, seen=None):
    """One row of headline numbers; the two percentiles are exact and distributed. ``seen`` is the one-row count of visible events where it is known."""
    seen = visible_events(events, cutoff).agg(F.count("*").alias("events")) if seen is None else seen
    counts = snapshot.agg(
        F.count("*").alias("incidents"), F.count_if("is_open").alias("backlog"),
        F.count_if(~F.col("is_open")).alias("resolved"),
        (F.avg((F.col("reopen_count") > 0).cast("double")) * 100).alias("reopened_pct"))
    hours = exact_percentiles(_closed_hours(snapshot), [], "closed_hours",
                              {"median_resolution_hours": 0.5, "p90_resolution_hours": 0.9})
    return seen.crossJoin(counts).crossJoin(hours)


def group_priority(snapshot):
    keys = ["assignment_group", "priority"]
    counts = snapshot.groupBy(*keys).agg(
        F.count("*").alias("incidents"), F.count_if("is_open").alias("open"),
        F.count_if(F.col("reopen_count") > 0).alias("reopened"),
        F.count_if(F.col("reassignment_count") > 0).alias("reassigned"))
    medians = exact_percentiles(_closed_hours(snapshot), keys, "closed_hours", {"median_resolution_hours": 0.5})
    return counts.join(medians, keys, "left").withColumnRenamed("assignment_group", "group")


def queue_health(snapshot, exact=False):
    """Open and reopened counts, mean and p90 resolution per group, busiest first.

    ``approx_percentile`` keeps a bounded sketch per group; ``exact`` selects the true percentile instead.
    """
    closed = _closed_hours(snapshot)
    columns = [F.count("*").alias("incidents"), F.count_if("is_open").alias("open_incidents"),
               F.count_if(F.col("reopen_count") > 0).alias("reopened_incidents"),
               F.avg("closed_hours").alias("mean_resolution_hours")]
    if not exact:
        columns.append(F.percentile_approx("closed_hours", 0.9).alias("p90_resolution_hours"))
    table = closed.groupBy("assignment_group").agg(*columns)
    if exact:
        p90 = exact_percentiles(closed, ["assignment_group"], "closed_hours", {"p90_resolution_hours": 0.9})
        table = table.join(p90, "assignment_group", "left")
    return table.orderBy(F.desc("open_incidents"), F.desc("incidents"), "assignment_group")


def filtered_groups(group_table, search="", priority=None, limit=None):
    """Drill-down: substring on the group name, optional priority, rolled up over priorities."""
    rows = group_table.filter(F.contains(F.lower("group"), F.lit(search.strip().lower())))
    if priority is not None:
        rows = rows.filter(F.col("priority") == priority)
    table = rows.groupBy("group").agg(*[F.sum(name).alias(name) for name in ("incidents", "open", "reopened", "reassigned")])
    table = table.orderBy(F.desc("open"), "group")
    return table.limit(limit) if limit else table


def profile_counts(events):
    """One row: unknown values per dimension, incidents with more than one opening, event time range."""
    conflicts = (events.groupBy("incident_id").agg((F.min("opened_at") < F.max("opened_at")).alias("conflict"))
                 .agg(F.count_if("conflict").alias("opened_at_conflicts")))
    totals = events.agg(*[F.count_if(F.col(name) == UNKNOWN).alias(f"unknown_{name}") for name in DIMENSIONS],
                        F.min("updated_at").alias("min_event_time"), F.max("updated_at").alias("max_event_time"))
    return totals.crossJoin(conflicts)


def state_counts(events):
    return events.groupBy("state").agg(F.count("*").alias("events"))


def profile(events):
    """Long form ``(measure, item, value)`` of the whole profile."""
    one = profile_counts(events)
    wide = one.select(F.explode(F.array(
        *[F.struct(F.lit("unknown_values").alias("measure"), F.lit(name).alias("item"),
                   F.col(f"unknown_{name}").cast("string").alias("value")) for name in DIMENSIONS],
        F.struct(F.lit("opened_at_conflicts").alias("measure"), F.lit("incidents").alias("item"),
                 F.col("opened_at_conflicts").cast("string").alias("value")),
        *[F.struct(F.lit("event_time").alias("measure"), F.lit(item).alias("item"),
                   F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias("value"))
          for item, column in (("min", "min_event_time"), ("max", "max_event_time"))])).alias("r")).select("r.*")
    states = state_counts(events).select(F.lit("states").alias("measure"), F.col("state").alias("item"),
                                         F.col("events").cast("string").alias("value"))
    return wide.unionByName(states)


def quality_totals(stats, previous=None):
    """Cumulative counters over runs: this run's merge statistics plus the previous one-row state."""
    if previous is None:
        total, bad = F.col("input_rows"), F.col("rejected_rows")
        joined = stats
    else:
        joined = stats.crossJoin(previous.select(F.col("source_rows").alias("_rows"), F.col("rejected_rows").alias("_bad")))
        total, bad = F.col("_rows") + F.col("input_rows"), F.col("_bad") + F.col("rejected_rows")
    return joined.select(total.alias("source_rows"), (total - bad).alias("accepted_rows"), bad.alias("rejected_rows"),
                         (bad / F.greatest(total, F.lit(1))).alias("reject_rate"))


def group_findings(events, snapshot, later_snapshot, cutoff, groups, top=5):
    """Drill-down of chosen assignment groups in long form ``(group, measure, item, value)``."""
    chosen = snapshot.filter(F.col("assignment_group").isin(*groups)).select(
        "incident_id", F.col("assignment_group").alias("group"), "state", "opened_at", "is_open", "age_hours",
        "reassignment_count")
    ids = chosen.select("incident_id", "group")
    # Events collapse to one row per incident before the membership join, so a hot incident never meets a join.
    first = visible_events(events, cutoff).groupBy("incident_id").agg(
        F.min(F.struct(*ORDER, "assignment_group")).getField("assignment_group").alias("first_group"),
        (F.min("assignment_group") == F.max("assignment_group")).alias("single_group")).join(ids, "incident_id")
    later = later_snapshot.select("incident_id", F.col("assignment_group").alias("later_group"),
                                  F.col("is_open").alias("later_open")).join(ids, "incident_id")

    def long(table, measure, item, value):
        return table.select("group", F.lit(measure).alias("measure"), item.cast("string").alias("item"),
                            value.cast("double").alias("value"))

    def counted(table, column, measure, limit=None):
        sizes = table.groupBy("group", F.col(column).alias("item")).agg(F.count("*").alias("n"))
        if limit:
            # One row per (chosen group, value): the ranking is over value labels, not incidents.
            rank = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("n"), "item"))
            sizes = sizes.withColumn("rank", rank).filter(F.col("rank") <= limit)
        return long(sizes, measure, F.col("item"), F.col("n"))

    totals = chosen.groupBy("group").agg(
        F.count("*").alias("incidents"), F.count_if("is_open").alias("open"),
        F.count_if(F.col("reassignment_count") > 0).alias("reassigned"))
    ages = exact_percentiles(chosen.filter("is_open"), ["group"], "age_hours", {"median": 0.5})
    parts = [long(totals, name, F.lit("all"), F.col(name)) for name in ("incidents", "open", "reassigned")]
    parts += [
        counted(chosen, "state", "states"),
        counted(chosen.withColumn("month", F.date_format("opened_at", "yyyy-MM")), "month", "opened_months"),
        counted(first, "first_group", "first_groups", top),
        counted(later, "later_group", "later_groups", top),
        long(ages, "median_open_age_hours", F.lit("all"), F.col("median")),
        long(later.groupBy("group").agg(F.count_if(~F.col("later_open")).alias("n")), "terminal_by_extract_end",
             F.lit("all"), F.col("n")),
        long(first.groupBy("group").agg(F.count_if("single_group").alias("n")), "only_one_observed_group",
             F.lit("all"), F.col("n")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def backlog_flow(daily, days=14):
    """Net change and balance over the last days of the daily queue (at most ``days`` rows)."""
    recent = daily.orderBy(F.desc("date")).limit(days)
    flow = (F.col("starting_backlog") + F.col("first_observed") + F.col("reopened_transitions")
            - F.col("resolved_transitions")) == F.col("backlog")
    return recent.agg(
        F.count("*").alias("days"), F.min_by("starting_backlog", "date").alias("first_backlog"),
        F.max_by("backlog", "date").alias("last_backlog"),
        F.bool_and(F.col("balance_ok") & flow).alias("balanced")).withColumn(
            "net_change", F.col("last_backlog") - F.col("first_backlog")).withColumn(
            "growing", F.col("net_change") > 0)


def reconcile(left, right):
    """Row-for-row comparison of two tables (multiset difference both ways); one row."""
    right = right.select(*left.columns)
    only_left = left.exceptAll(right).agg(F.count("*").alias("only_left"))
    only_right = right.exceptAll(left).agg(F.count("*").alias("only_right"))
    return only_left.crossJoin(only_right).withColumn("passed", F.col("only_left") + F.col("only_right") == 0)


def fingerprint(table, by=()):
    """Order-free fingerprint of the rows (of each part ``by``): their count and the sums of two hashes. Equal multisets of rows have equal fingerprints."""
    columns = [F.col(name) for name in sorted(set(table.columns) - set(by))]
    wide = lambda *extra: F.sum(F.xxhash64(*extra, *columns).cast("decimal(38,0)"))
    return table.groupBy(*by).agg(F.count("*").alias("rows"), wide().alias("a"), wide(F.lit("second")).alias("b"))


def differing_parts(left, right, by):
    """Parts in which two tables do not hold the same rows, with both row counts. Each table is read once; only fingerprints are joined."""
    one, other = fingerprint(left, by).alias("l"), fingerprint(right.select(*left.columns), by).alias("r")
    same = " AND ".join(f"l.{name} <=> r.{name}" for name in by)
    joined = one.join(other, F.expr(same), "full")
    unlike = F.expr("NOT (l.rows <=> r.rows AND l.a <=> r.a AND l.b <=> r.b)")
    return joined.filter(unlike).select(*[F.coalesce(f"l.{name}", f"r.{name}").alias(name) for name in by], F.coalesce("l.rows", F.lit(0)).alias("left_rows"),
                                        F.coalesce("r.rows", F.lit(0)).alias("right_rows"))


def workflow_state(registry, processed, cutoff, previous_as_of, max_as_of):
    """Delivery counts of a run and whether the source is exhausted at this cutoff."""
    fresh = registry.join(processed.select("batch_id"), "batch_id", "left_anti").filter(
        F.col("available_as_of") <= F.lit(str(cutoff))).agg(F.count("*").alias("new_batches"))
    done = processed.agg(F.count("*").alias("done"))
    return done.crossJoin(fresh).select(
        (F.col("done") + F.col("new_batches")).alias("processed_batches"), "new_batches",
        F.lit(previous_as_of).cast("string").alias("previous_as_of"),
        F.lit(str(cutoff) >= str(max_as_of)).alias("source_exhausted"))


# Report parts that may leave the private area.
PUBLIC_FIELDS = ("mode", "as_of", "timezone", "source", "summary", "quality", "groups", "daily", "definitions",
                 "generated_at", "integrity", "profile", "workflow")


def public_report(report):
    """Allow-listed columns of a one-row report; the fingerprint inside ``quality`` is dropped."""
    kept = [name for name in PUBLIC_FIELDS if name in report.columns]
    public = report.select(*kept)
    if "quality" in kept and "source_sha256" in report.schema["quality"].dataType.names:
        public = public.withColumn("quality", F.col("quality").dropFields("source_sha256"))
    return public
