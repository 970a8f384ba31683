import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.operators import merge

SCHEMA = ("event_id string, revision int, incident_id string, updated_at timestamp_ntz, content_hash string, batch_id string, "
          "available_as_of string, position long")


def delivery(event, revision, batch, position, incident="INC1", content=None, day=1):
    return (event, revision, incident, datetime(2016, 3, 1) + timedelta(days=day), content or f"{event}-{revision}",
            f"b{batch}", f"2016-03-{batch:02d} 23:59:59", position)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def sequential(history, rows, previous):
    """Apply deliveries one by one in arrival order."""
    versions, latest, outcomes, duplicates = dict(history), {}, {}, 0
    for event, revision in versions:
        latest[event] = max(latest.get(event, 0), revision)
    for row in sorted(rows, key=lambda r: (r[6], r[5], r[7])):
        key = row[0], row[1]
        if key in versions:
            duplicates += 1
            continue
        versions[key] = row
        if row[0] not in latest:
            outcomes[key] = "inserted"
        else:
            outcomes[key] = "corrected" if row[1] > latest[row[0]] else "stale"
        latest[row[0]] = max(latest.get(row[0], 0), row[1])
    late = {k for k, o in outcomes.items() if o != "stale" and versions[k][3] <= previous}
    return versions, latest, outcomes, duplicates, late


@pytest.mark.parametrize("seed, block", [(1, 4), (2, 65536), (3, 1)])
def test_merge_equals_one_by_one_application(spark, seed, block):
    """A third of the deliveries belongs to one event with very many versions."""
    source = random.Random(seed)
    rows = []
    for i in range(500):
        event = "hot" if i % 3 == 0 else f"e{source.randrange(60)}"
        revision = source.randrange(1, 150 if event == "hot" else 6)
        rows.append(delivery(event, revision, source.randrange(1, 9), i, day=source.randrange(20)))
    old = [r for r in rows if r[6] <= "2016-03-04 99"]
    new = [r for r in rows if r[6] > "2016-03-04 99"]
    previous = datetime(2016, 3, 12)
    stored, *_ = sequential({}, old, previous)
    versions, latest, outcomes, duplicates, late = sequential(stored, new, previous)
    history = merge.merge_deliveries(None, frame(spark, old), block=block).history
    result = merge.merge_deliveries(history, frame(spark, new), previous, block=block)
    found = {(r["event_id"], r["revision"]): r for r in result.versions.collect()}
    assert {k: r["outcome"] for k, r in found.items() if r["outcome"] != "kept"} == outcomes
    assert {(r["event_id"], r["revision"]): r["batch_id"] for r in result.history.collect()} == {k: r[5] for k, r in versions.items()}
    assert {r["event_id"]: r["revision"] for r in result.current.collect()} == latest
    counts = result.counts.first()
    assert counts["duplicates"] == duplicates and counts["late_arrivals"] == len(late)
    assert counts["stale_revisions"] == sum(o == "stale" for o in outcomes.values())
    current = merge.merge_deliveries(None, frame(spark, old), block=block).current
    refreshed = merge.refreshed_current(current, result.new)
    assert {r["event_id"]: r["revision"] for r in refreshed.collect()} == latest


def test_conflicting_payload_and_moved_incident_are_refused(spark):
    history = frame(spark, [delivery("e1", 1, 1, 1)])
    with pytest.raises(ValueError, match="two payloads"):
        merge.require_consistent(history, frame(spark, [delivery("e1", 1, 2, 1, content="other")]))
    with pytest.raises(ValueError, match="two incidents"):
        merge.require_consistent(history, frame(spark, [delivery("e1", 2, 2, 1, incident="INC2")]))
    merge.require_consistent(history, frame(spark, [delivery("e1", 1, 2, 1), delivery("e1", 2, 2, 2)]))


def test_delivering_everything_again_changes_nothing(spark):
    rows = [delivery("e1", 1, 1, 1), delivery("e1", 2, 1, 2), delivery("e2", 1, 1, 3)]
    first = merge.merge_deliveries(None, frame(spark, rows))
    again = merge.merge_deliveries(first.history, frame(spark, rows))
    assert again.history.count() == 3
    assert again.counts.select("inserted", "corrected", "duplicates").first() == (0, 0, 3)
    assert again.versions.filter(F.col("outcome") != "kept").isEmpty()
