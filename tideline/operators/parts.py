"""Parts of the incident tables: ranges of incident numbers. Numbers rise with time, so an increment touches few of them.

What a report needs of a part is kept as small tables that add up over parts, so that other parts' events are not read again.
"""
from pyspark.sql import functions as F

from tideline.functions.text import UNKNOWN, dimension_key
from tideline.functions.timecols import date_key
from tideline.operators.history import visible_events
from tideline.operators.normalize import DIMENSIONS

#: Incidents of neighbouring numbers that are kept together.
WIDTH = 100_000


def part_of(incident_id, width=WIDTH):
    """Range of an incident number; -1 for names without a number that fits."""
    return F.coalesce(F.floor(F.substring(incident_id, 4, 30).try_cast("bigint") / F.lit(width)).cast("bigint"), F.lit(-1).cast("bigint"))


def with_part(rows, width=WIDTH):
    return rows.withColumn("part", part_of(F.col("incident_id"), width))


def members(events, cutoff):
    """Visible events per (part, group, priority) with the earliest opening."""
    return (visible_events(events, cutoff).groupBy("part", "assignment_group", "priority")
            .agg(F.count("*").alias("events"), F.min("opened_at").alias("first_opened")))


def dim_assignment_group(all_members):
    return all_members.select("assignment_group").distinct().select(dimension_key(F.col("assignment_group")).alias("group_key"), "assignment_group")


def dim_priority(all_members):
    return all_members.select("priority").distinct().select(dimension_key(F.col("priority")).alias("priority_key"), "priority")


def dim_date(all_members, cutoff):
    """Every day from the earliest opening to the cutoff."""
    span = all_members.agg(F.to_date(F.min("first_opened")).alias("first"))
    days = span.select(F.explode(F.sequence("first", F.to_date(F.lit(str(cutoff)[:10])))).alias("date"))
    return days.select(date_key(F.col("date")).alias("date_key"), "date", F.year("date").alias("year"), F.month("date").alias("month"),
                       F.dayofmonth("date").alias("day"), F.date_format("date", "EEEE").alias("weekday"), (F.weekday("date") >= 5).alias("is_weekend"))


def profile_parts(events):
    """The profile's counts and times per part: ``part, measure, item, n, low, high``."""
    none = F.lit(None).cast("timestamp_ntz")
    incidents = events.groupBy("part", "incident_id").agg((F.min("opened_at") < F.max("opened_at")).alias("conflict"))
    conflicts = incidents.groupBy("part").agg(F.count_if("conflict").alias("n")).select(
        "part", F.lit("opened_at_conflicts").alias("measure"), F.lit("incidents").alias("item"), "n", none.alias("low"), none.alias("high"))
    totals = events.groupBy("part").agg(*[F.count_if(F.col(name) == UNKNOWN).alias(name) for name in DIMENSIONS],
                                        F.min("updated_at").alias("low"), F.max("updated_at").alias("high"))
    pieces = [F.struct(F.lit("unknown_values").alias("measure"), F.lit(name).alias("item"), F.col(name).alias("n"), none.alias("low"), none.alias("high")) for name in DIMENSIONS]
    pieces.append(F.struct(F.lit("event_time").alias("measure"), F.lit("range").alias("item"), F.lit(0).cast("bigint").alias("n"), "low", "high"))
    unknown = totals.select("part", F.explode(F.array(*pieces)).alias("p")).select("part", "p.*")
    states = events.groupBy("part", "state").agg(F.count("*").alias("n")).select(
        "part", F.lit("states").alias("measure"), F.col("state").alias("item"), "n", none.alias("low"), none.alias("high"))
    return conflicts.unionByName(unknown).unionByName(states)


def profile(all_parts):
    """Long form ``(measure, item, value)`` of the whole profile."""
    joined = all_parts.groupBy("measure", "item").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    shown = lambda column: F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    rows = F.when(F.col("measure") == "event_time", F.array(F.struct(F.lit("min").alias("item"), shown("low").alias("value")),
                                                            F.struct(F.lit("max").alias("item"), shown("high").alias("value")))).otherwise(
        F.array(F.struct("item", F.col("n").cast("string").alias("value"))))
    return joined.select("measure", F.explode(rows).alias("r")).select("measure", "r.*")


def total_flows(part_flows):
    """Flows of all parts, one row a day."""
    names = ("first_observed", "resolved_transitions", "reopened_transitions", "open_change")
    return part_flows.groupBy("date").agg(*[F.sum(name).alias(name) for name in names])
