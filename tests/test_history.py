import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.operators import history as hs
from tideline.operators import reports
from tideline.operators.normalize import STATES, TERMINAL

SCHEMA = ("event_id string, source_row long, incident_id string, state string, opened_at timestamp_ntz, updated_at timestamp_ntz, "
          "event_date date, sys_mod_count int, priority string, assignment_group string, category string, contact_type string, "
          "reopen_count int, reassignment_count int")


def event(row, incident, state, at, mod=0, opened=datetime(2016, 3, 1, 9)):
    return (f"e{row}", row, incident, state, opened, at, at.date(), mod, "P", "G", "C", "Phone", 0, 0)


def at(day, hour=10):
    return datetime(2016, 3, day, hour)


def tables(spark, rows, cutoff, hours=1):
    events = spark.createDataFrame(rows, SCHEMA)
    summary = hs.segment_summary(events, cutoff, hours)
    return events, hs.incident_snapshot(summary, cutoff), hs.daily_queue(summary, cutoff, hours=hours)


def test_first_resolution_and_reopening(spark):
    rows = [event(2, "INC1", "New", at(1)), event(3, "INC1", "Resolved", at(2)), event(4, "INC1", "Active", at(3))]
    for cutoff, backlog, median in (("2016-03-01 23:59:59", 1, None), ("2016-03-02 23:59:59", 0, 25.0), ("2016-03-03 23:59:59", 1, None)):
        events, snapshot, daily = tables(spark, rows, cutoff)
        summary = reports.summary(events, snapshot, cutoff).first()
        assert (summary["backlog"], summary["median_resolution_hours"]) == (backlog, median)
    assert [r["backlog"] for r in daily.orderBy("date").collect()] == [1, 0, 1]


def test_latest_cycle_gives_the_duration_and_quiet_days_stay(spark):
    rows = [event(2, "INC1", "New", at(1)), event(3, "INC1", "Resolved", at(2)), event(4, "INC1", "Active", at(3)),
            event(5, "INC1", "Closed", at(4))]
    _, snapshot, daily = tables(spark, rows, "2016-03-05 23:59:59")
    assert snapshot.first()["resolution_hours"] == 73
    assert [r["backlog"] for r in daily.orderBy("date").collect()] == [1, 0, 1, 0, 0]


def test_empty_snapshot_is_an_error(spark):
    events = spark.createDataFrame([event(2, "INC1", "New", at(5))], SCHEMA)
    with pytest.raises(ValueError, match="No event is visible"):
        hs.require_visible(events, "2016-03-01 00:00:00")


def random_rows(seed, n=600):
    """A third of all rows belongs to one incident, many on the same minute."""
    source = random.Random(seed)
    rows = []
    for i in range(n):
        incident = "INC0" if i % 3 == 0 else f"INC{source.randrange(1, 60)}"
        moment = datetime(2016, 3, 1) + timedelta(minutes=source.choice([0, 1, 61, 600, 1500, 3000, source.randrange(20000)]))
        rows.append(event(i + 2, incident, source.choice(STATES), moment, source.randrange(3), datetime(2016, 2, 20)))
    return rows


def sequential(rows, cutoff):
    """One pass in order, as a person would keep the books."""
    seen = sorted((r for r in rows if r[5] <= cutoff), key=lambda r: (r[5], r[7], r[1]))
    latest, entered, resolved, days = {}, {}, {}, {}
    for r in seen:
        incident, state, moment = r[2], r[3], r[5]
        day = days.setdefault(moment.date(), [0, 0, 0])
        before = latest.get(incident)
        done, was_done = state in TERMINAL, before is not None and before[3] in TERMINAL
        day[0] += before is None
        day[1] += done and not was_done
        day[2] += was_done and not done
        if not done:
            entered.pop(incident, None)
            resolved.pop(incident, None)
        else:
            entered.setdefault(incident, moment)
            if state == "Resolved":
                resolved[incident] = moment
        latest[incident] = r
    closings = {k: (resolved.get(k) or entered.get(k)) for k in latest}
    return latest, closings, days, seen


@pytest.mark.parametrize("hours, seed", [(1, 1), (6, 2), (24, 3)])
def test_segmented_results_equal_a_sequential_pass(spark, hours, seed):
    rows, cutoff = random_rows(seed), datetime(2016, 3, 10, 12)
    latest, closings, days, seen = sequential(rows, cutoff)
    events, snapshot, daily = tables(spark, rows, cutoff, hours)
    found = {r["incident_id"]: r for r in snapshot.collect()}
    assert {k: r["event_id"] for k, r in found.items()} == {k: r[0] for k, r in latest.items()}
    assert {k: r["observed_resolution_at"] for k, r in found.items()} == closings
    flows = {r["date"]: [r["first_observed"], r["resolved_transitions"], r["reopened_transitions"]] for r in daily.collect()}
    assert all(flows[day] == values for day, values in days.items())
    assert all(r["balance_ok"] for r in daily.collect())
    history = {}
    for r in hs.incident_history(events, cutoff, hours).collect():
        history.setdefault(r["incident_id"], []).append(r)
    for incident, items in history.items():
        items.sort(key=lambda r: r["event_order"])
        expected = [r for r in seen if r[2] == incident]
        assert [r["event_id"] for r in items] == [r[0] for r in expected]
        assert [r["event_order"] for r in items] == list(range(1, len(items) + 1))
        assert [r["previous_state"] for r in items] == [None] + [r[3] for r in expected[:-1]]
        assert [r["valid_to"] for r in items] == [r[5] for r in expected[1:]] + [None]


def test_later_events_do_not_move_an_earlier_snapshot(spark):
    rows, cutoff = random_rows(9, 200), datetime(2016, 3, 8)
    changed = [r if r[5] <= cutoff else (*r[:3], "Closed", *r[4:]) for r in rows]
    one, two = (sorted(map(tuple, tables(spark, data, cutoff)[1].collect())) for data in (rows, changed))
    assert one == two


def test_cutoff_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(random_rows(4, 50), SCHEMA).write.partitionBy("event_date").parquet(str(tmp_path / "e"))
    events = spark.read.parquet(str(tmp_path / "e"))
    plan = hs.visible_events(events, "2016-03-03 00:00:00")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "updated_at,2016-03-03" in plan.replace("LessThanOrEqual(", "")


def test_filtered_groups_and_flow(spark):
    table = spark.createDataFrame([("Group 1", "P", 3, 2, 0, 1), ("Group 1", "Q", 2, 1, 0, 1), ("Group 2", "P", 9, 9, 0, 0)],
                                  "group string, priority string, incidents int, open int, reopened int, reassigned int")
    assert [tuple(r) for r in reports.filtered_groups(table, " gROUP 1 ").collect()] == [("Group 1", 5, 3, 0, 2)]
    assert [r["group"] for r in reports.filtered_groups(table, priority="P", limit=1).collect()] == ["Group 2"]
    same = table.filter(F.lit(True))
    assert reports.reconcile(table, same).first()["passed"]
    assert not reports.reconcile(table, table.filter("incidents > 2")).first()["passed"]
