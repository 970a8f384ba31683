from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.operators import ledger as ld
from tideline.operators import operations as op

CUTOFF = date(2026, 3, 31)


def publications(spark, rows):
    """rows: (series, target, generated_at UTC, prediction)."""
    frame = spark.createDataFrame(rows, "series string, target date, generated_at string, prediction long")
    return frame.withColumn("generated_at", F.col("generated_at").cast("timestamp")).withColumns({
        "version": F.lit("v1"), "lower": F.col("prediction") - 1, "upper": F.col("prediction") + 1,
        "candidates": F.create_map(F.lit("x"), F.col("prediction").cast("double")),
        "shadow_intervals": F.create_map(F.lit("m"), F.struct(F.col("prediction").alias("lower"), F.col("prediction").alias("upper")))})


def test_first_publication_of_a_new_york_day_wins(spark):
    day = date(2026, 3, 12)
    rows = publications(spark, [("s", day, "2026-03-11 03:30:00", 1), ("s", day, "2026-03-11 02:00:00", 2), ("s", day, "2026-03-11 12:00:00", 3),
                                ("s", date(2026, 3, 10), "2026-03-11 02:00:00", 4)])
    issued = ld.issuance(rows)
    assert sorted((str(r["issued_date"]), r["prediction"]) for r in issued.collect()) == [("2026-03-10", 1), ("2026-03-10", 2), ("2026-03-11", 3)]
    ledger = ld.record_publication(issued.limit(0), issued)
    assert sorted((str(r["issued_date"]), r["prediction"]) for r in ledger.collect()) == [("2026-03-10", 2), ("2026-03-11", 3)]
    assert ld.record_publication(ledger, issued.withColumn("prediction", F.lit(9))).count() == 2


def test_actuals_freeze_once_mature(spark):
    rows = publications(spark, [("s", CUTOFF - timedelta(days=d), "2026-03-01 12:00:00", 10) for d in (6, 7, 8)])
    issued = ld.issuance(rows)
    actuals = spark.createDataFrame([("s", CUTOFF - timedelta(days=d), 100 + d) for d in range(20)], "series string, day date, value int")
    empty = spark.createDataFrame([], "series string, target date, value int")
    frozen = ld.freeze_actuals(empty, issued, actuals, CUTOFF)
    assert sorted(r["value"] for r in frozen.collect()) == [107, 108]
    later = ld.freeze_actuals(frozen, issued, actuals.withColumn("value", F.lit(0)), CUTOFF + timedelta(days=1))
    assert sorted(r["value"] for r in later.collect()) == [0, 107, 108]
    assert ld.pending(issued, CUTOFF).count() == 1
    assert ld.score_ledger(issued, frozen, CUTOFF).count() == 2
    first = ld.freeze_actuals(None, issued, actuals, CUTOFF, "monday", "aa")
    second = ld.freeze_actuals(first, issued, actuals, CUTOFF + timedelta(days=1), "tuesday", "bb").collect()
    assert sorted((r["value"], r["observed_at"], r["source_sha256"]) for r in second) == [(106, "tuesday", "bb"), (107, "monday", "aa"), (108, "monday", "aa")]
    assert ld.freeze_actuals(first, issued.limit(0), actuals, CUTOFF + timedelta(days=113), "later", "cc").count() == 1


def scored(spark, rows_per_day, hits, version="v1"):
    rows = [("s", CUTOFF - timedelta(days=8 + d), 1 + k, 10 if k < hits else 50, 10, 9, 11, version)
            for d in range(14) for k in range(rows_per_day)]
    return spark.createDataFrame(rows, "series string, target date, lead_days int, actual int, prediction int, lower int, upper int, version string")


def test_every_series_has_all_lead_bands(spark):
    frame = scored(spark, 2, 2)
    members = spark.createDataFrame([("s",), ("silent",)], "series string")
    found = {(r["series"], r["lead"]): (r["predictions"], r["wape_pct"]) for r in ld.by_lead(frame, members).collect()}
    assert found == {("s", "1–3"): (28, 0.0), **{(s, b): (0, None) for s, b in (("s", "4–7"), ("s", "8–14"), ("silent", "1–3"), ("silent", "4–7"), ("silent", "8–14"))}}


@pytest.mark.parametrize("rows, hits, status", [(1, 1, "Collecting outcomes"), (2, 2, "Monitoring"), (2, 1, "Undercoverage warning")])
def test_cohort_status(spark, rows, hits, status):
    frame = scored(spark, rows, hits)
    members = spark.createDataFrame([("s",), ("silent",)], "series string")
    waiting = frame.limit(0)
    found = {r["series"]: r for r in ld.cohorts(frame, waiting, members, ["series"]).collect()}
    assert found["s"]["status"] == status and found["s"]["distinct_target_dates"] == 14
    assert found["silent"]["status"] == "Collecting outcomes" and found["silent"]["scored_predictions"] == 0
    assert found["s"]["above_band"] == 14 * (rows - hits)


def test_health_keeps_thirty_runs_with_failures_and_unknowns(spark):
    rows = [(i, f"{i:03}", "SUCCEEDED", float(i)) for i in range(35)]
    rows[-1] = (34, "034", "STARTED", 34.0)
    rows[-2] = (33, "033", "FAILED", 33.0)
    row = op.run_health(spark.createDataFrame(rows, "id int, started_at string, status string, duration_seconds double")).first()
    assert (row["runs"], row["completed"], round(row["success_rate_pct"], 1), row["p50_seconds"], row["p95_seconds"]) == (30, 29, 96.6, 19, 32)
    empty = op.run_health(spark.createDataFrame([], "id int, started_at string, status string, duration_seconds double")).first()
    assert empty["success_rate_pct"] is None and empty["p50_seconds"] is None


def test_page_views_count_every_row(spark):
    start = datetime(2026, 3, 1)
    rows = [("it" if i % 2 else "forecast", start + timedelta(seconds=i % 80_000), i) for i in range(25_000)]
    rows += [("evil", start, 30_000), ("resolution", start + timedelta(days=2), 30_001)]
    frame = op.page_counts(spark.createDataFrame(rows, "page string, at timestamp_ntz, id int"))
    counts = {r["day"]: r for r in frame.collect()}
    assert (counts[date(2026, 3, 1)]["forecast"], counts[date(2026, 3, 1)]["it"]) == (12_500, 12_500)
    daily = op.usage_summary(frame, date(2026, 3, 5)).orderBy("day").collect()
    assert [(r["day"].day, r["total"]) for r in daily] == [(1, 25_000), (2, 0), (3, 1), (4, 0)]
    assert op.usage_totals(op.usage_summary(frame, date(2026, 3, 5), date(2026, 3, 2))).first()["total_views"] == 1
