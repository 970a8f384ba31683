from datetime import datetime
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tideline.functions.text import content_hash_json, dimension_key
from tideline.functions.timecols import parse_day_first
from tideline.operators import normalize as nz

GOOD = {"number": "INC1", "incident_state": "New", "opened_at": "1/3/2016 09:00", "sys_updated_at": "1/3/2016 10:00",
        "sys_mod_count": "0", "priority": "3 - Moderate", "assignment_group": "Group 1", "category": "Category 1",
        "contact_type": "Phone", "reopen_count": "0", "reassignment_count": "0"}


def raw(spark, *changes):
    rows = [{**GOOD, **change} for change in changes]
    names = list(GOOD)
    schema = "source_sha256 string, source_row int, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([("a" * 64, i + 2, *[row[n] for n in names]) for i, row in enumerate(rows)], schema)


@pytest.mark.parametrize("change, expected", [
    ({}, []),
    ({"number": " "}, ["missing_incident_id"]),
    ({"number": "INC1a"}, ["invalid_incident_id"]),
    ({"incident_state": "-100"}, ["unknown_state"]),
    ({"opened_at": "?"}, ["missing_opened_at"]),
    ({"opened_at": None}, ["missing_opened_at"]),
    ({"sys_updated_at": "31/2/2016 10:00"}, ["invalid_sys_updated_at"]),
    ({"sys_updated_at": "1/3/16 10:00"}, ["invalid_sys_updated_at"]),
    ({"sys_updated_at": "1/3/2016 24:00"}, ["invalid_sys_updated_at"]),
    ({"sys_updated_at": "29/2/2016 10:00"}, ["update_before_open"]),
    ({"sys_mod_count": "-1"}, ["negative_sys_mod_count", "invalid_sys_mod_count"]),
    ({"reopen_count": "1.5", "reassignment_count": None}, ["invalid_reopen_count", "invalid_reassignment_count"]),
    ({"number": "?", "incident_state": "x", "opened_at": "x", "sys_mod_count": ""},
     ["missing_incident_id", "unknown_state", "invalid_opened_at", "invalid_sys_mod_count"]),
])
def test_every_reason_is_reported(spark, change, expected):
    assert nz.validate_rows(raw(spark, change)).first()["errors"] == expected


def test_accepted_rows_are_typed_and_carry_no_outcome_columns(spark):
    frame = raw(spark, {"assignment_group": " ? ", "category": "  ", "number": "\tINC7 "}).withColumn("resolved_at", F.lit("x"))
    event = nz.accepted(nz.validate_rows(frame)).first()
    assert tuple(event.asDict()) == nz.EVENT_FIELDS
    assert (event["incident_id"], event["assignment_group"], event["category"]) == ("INC7", "Unknown", "Unknown")
    assert event["updated_at"] == datetime(2016, 3, 1, 10)
    assert event["event_id"] == sha256(("a" * 64 + ":2").encode()).hexdigest()


def test_identical_source_rows_stay_two_events_and_bad_rows_are_quarantined(spark):
    checked = nz.validate_rows(raw(spark, {}, {}, {"number": "x"}))
    assert nz.accepted(checked).select("event_id").distinct().count() == 2
    assert nz.quarantined(checked).first()["errors"] == ["invalid_incident_id"]
    quality = nz.load_quality(checked).first()
    assert (quality["source_rows"], quality["accepted_rows"], quality["rejected_rows"]) == (3, 2, 1)


def test_missing_header_fails_before_reading():
    with pytest.raises(ValueError, match="required names: number"):
        nz.validate_headers([name for name in nz.REQUIRED if name != "number"])


def test_gate_refuses_too_many_bad_rows(spark):
    stats = spark.createDataFrame([(0.02, 10)], "reject_rate double, events long")
    with pytest.raises(ValueError, match="Quality gate"):
        nz.enforce(nz.quality_gate(stats), "Quality gate failed")
    assert nz.enforce(nz.quality_gate(stats, 0.05), "x")["passed"]


def test_parse_accepts_short_fields_only_in_shape(spark):
    texts = ["1/3/2016 9:5", " 01/03/2016   09:05 ", "2016-03-01 09:05", "001/3/2016 9:5", "1/13/2016 9:05"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_day_first(F.col("t")).alias("p"))
    stamp = datetime(2016, 3, 1, 9, 5)
    assert [row["p"] for row in frame.collect()] == [stamp, stamp, None, None, None]


def test_hashes(spark):
    frame = spark.createDataFrame([('{"a":1,"b":{"d":2,"c":3}}', '{"b":{"c":3,"d":2},"a":1}')], "x string, y string")
    row = frame.select((content_hash_json(F.col("x")) == content_hash_json(F.col("y"))).alias("same"),
                       dimension_key(F.lit("Group 1")).alias("key")).first()
    assert row["same"] and row["key"] == sha256(b"Group 1").hexdigest()[:16]
