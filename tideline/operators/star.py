"""Dimensions, the dimensional fact build, and integrity checks over both."""
from pyspark.sql import functions as F

from tideline.functions.text import dimension_key
from tideline.functions.timecols import date_key, ntz
from tideline.operators.history import visible_events


def dim_assignment_group(events, cutoff):
    return (visible_events(events, cutoff).select("assignment_group").distinct()
            .select(dimension_key(F.col("assignment_group")).alias("group_key"), "assignment_group"))


def dim_priority(events, cutoff):
    return (visible_events(events, cutoff).select("priority").distinct()
            .select(dimension_key(F.col("priority")).alias("priority_key"), "priority"))


def dim_date(events, cutoff):
    """Every day from the earliest opening to the cutoff."""
    span = visible_events(events, cutoff).agg(F.to_date(F.min("opened_at")).alias("first"))
    days = span.select(F.explode(F.sequence("first", F.to_date(F.lit(str(cutoff)[:10])))).alias("date"))
    return days.select(date_key(F.col("date")).alias("date_key"), "date", F.year("date").alias("year"),
                       F.month("date").alias("month"), F.dayofmonth("date").alias("day"),
                       F.date_format("date", "EEEE").alias("weekday"), (F.weekday("date") >= 5).alias("is_weekend"))


def fact_snapshot(stage, groups, priorities, dates):
    """Four inner equi joins, the date dimension playing two roles. Join strategy follows true table sizes."""
    opened = dates.select(F.col("date_key").alias("opened_date_key"))
    taken = dates.select(F.col("date_key").alias("snapshot_date_key"))
    return (stage.join(groups.select("group_key"), "group_key").join(priorities.select("priority_key"), "priority_key")
            .join(opened, "opened_date_key").join(taken, "snapshot_date_key").select(*stage.columns))


def join_grain(stage, fact):
    """One row: did the dimensional joins keep the grain?"""
    before = stage.agg(F.count("*").alias("stage_rows"))
    after = fact.agg(F.count("*").alias("fact_rows"))
    return before.crossJoin(after).withColumn("passed", F.col("stage_rows") == F.col("fact_rows"))


def aggregate_queue(fact, groups, priorities):
    """Queue counts per group and priority through the dimensions; counted per key before the joins."""
    keyed = fact.groupBy("group_key", "priority_key").agg(*_queue_counts())
    return (keyed.join(groups, "group_key").join(priorities, "priority_key")
            .groupBy(F.col("assignment_group").alias("group_name"), "priority")
            .agg(*[F.sum(name).alias(name) for name in ("incidents", "open_count", "reopened", "reassigned")]))


def _queue_counts():
    return [F.count("*").alias("incidents"), F.count_if("is_open").alias("open_count"),
            F.count_if(F.col("reopen_count") > 0).alias("reopened"),
            F.count_if(F.col("reassignment_count") > 0).alias("reassigned")]


def verify_integrity(fact, groups, priorities, dates):
    """Independent audit of a published fact: left joins counted for missing keys."""
    g = groups.select("group_key", F.lit(True).alias("g"))
    p = priorities.select("priority_key", F.lit(True).alias("p"))
    d = dates.select(F.col("date_key").alias("opened_date_key"), F.lit(True).alias("d"))
    return (fact.join(g, "group_key", "left").join(p, "priority_key", "left").join(d, "opened_date_key", "left")
            .agg(F.count("*").alias("snapshot_rows"), F.count_distinct("incident_id").alias("unique_incidents"),
                 F.count_if("is_open").alias("backlog"), F.count_if(F.col("g").isNull()).alias("missing_group"),
                 F.count_if(F.col("p").isNull()).alias("missing_priority"),
                 F.count_if(F.col("d").isNull()).alias("missing_opened_date"),
                 F.count_if(F.col("resolution_hours") < 0).alias("negative_resolution")))


def fk_violations(fact, groups, priorities, dates):
    """Keys of the fact absent from their dimension, with row counts; distinct keys are taken first."""
    def missing(column, dimension, key):
        used = fact.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("rows"))
        known = dimension.select(F.col(key).cast("string").alias("key"))
        return used.join(known, "key", "left_anti").select(F.lit(column).alias("foreign_key"), "key", "rows")

    return (missing("group_key", groups, "group_key")
            .unionByName(missing("priority_key", priorities, "priority_key"))
            .unionByName(missing("opened_date_key", dates, "date_key"))
            .unionByName(missing("snapshot_date_key", dates, "date_key")))


def _duplicates(table, key):
    return table.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad"))


def _named(row, **columns):
    """One-row aggregate to one ``(name, violations)`` row per column, so shared scans happen once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), column.cast("bigint").alias("violations"))
                                for name, column in columns.items()]))
    return row.select(pairs.alias("c")).select("c.*")


def integrity_checks(events, fact, history, groups, priorities, dates, summary_row, group_table, daily, cutoff):
    """Sixteen named checks, one row each. Every check is an aggregate; rows never leave the executors.

    ``summary_row`` and ``group_table`` are the report tables being checked (stored, not recomputed per check).
    """
    missing = fk_violations(fact, groups, priorities, dates).agg(*[
        F.coalesce(F.sum(F.when(F.col("foreign_key").isin(*columns), F.col("rows"))), F.lit(0)).alias(name)
        for name, columns in (("dates", ("opened_date_key", "snapshot_date_key")), ("groups", ("group_key",)),
                              ("priorities", ("priority_key",)))])
    durations = fact.agg(
        F.count_if((F.col("resolution_hours") < 0) | (F.col("age_hours") < 0)).alias("negative"),
        F.count_if(F.col("updated_at") > ntz(cutoff)).alias("future"))
    current = history.groupBy("incident_id").agg(
        F.count_if("is_current").alias("n"), F.count_if(F.col("valid_to") < F.col("valid_from")).alias("reversed")).agg(
        F.count_if(F.col("n") != 1).alias("current"), F.coalesce(F.sum("reversed"), F.lit(0)).alias("reversed"))
    totals = (summary_row.select("incidents", "backlog", "resolved")
              .crossJoin(group_table.agg(F.sum("incidents").alias("grouped")))
              .crossJoin(daily.agg(F.max_by("backlog", "date").alias("last_backlog"), F.count_if(~F.col("balance_ok")).alias("unbalanced"))))
    wrong = lambda condition: condition.cast("int")
    parts = [_named(_duplicates(table, key), **{name: F.col("bad")}) for name, table, key in (
        ("event_identity_unique", events, "event_id"), ("incident_grain_unique", fact, "incident_id"),
        ("group_dimension_unique", groups, "group_key"), ("priority_dimension_unique", priorities, "priority_key"),
        ("date_dimension_unique", dates, "date_key"))]
    parts += [
        _named(missing, date_foreign_keys_valid=F.col("dates"), group_foreign_keys_valid=F.col("groups"),
               priority_foreign_keys_valid=F.col("priorities")),
        _named(current, one_current_history_row=F.col("current"), history_intervals_valid=F.col("reversed")),
        _named(durations, nonnegative_durations=F.col("negative"), no_future_events_in_mart=F.col("future")),
        _named(totals, incident_balance=wrong(F.col("incidents") != F.col("backlog") + F.col("resolved")),
               group_totals_reconcile=wrong(F.col("grouped") != F.col("incidents")),
               last_daily_backlog_reconciles=wrong(F.col("last_backlog") != F.col("backlog")),
               daily_flow_balance=F.col("unbalanced")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("passed", F.col("violations") == 0)


def enforce_integrity(checks):
    """Sixteen rows at most reach the driver."""
    failed = sorted(row["name"] for row in checks.filter(~F.col("passed")).collect())
    if failed:
        raise ValueError(f"Integrity checks failed: {', '.join(failed)}")
    return checks
