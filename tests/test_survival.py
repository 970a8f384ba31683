import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import survival as sv

HOUR = sv.HOUR


def durations(spark, rows):
    return spark.createDataFrame([(float(d), int(d * HOUR), e, p) for d, e, p in rows],
                                 "duration double, duration_us long, event boolean, priority string")


def test_censored_cases_stay_in_the_risk_set(spark):
    rows = durations(spark, [(2, True, "P"), (3, False, "P"), (4, True, "P")])
    curve = {r["time"]: r["survival"] for r in sv.km_curve(rows).collect()}
    assert curve == {2.0: pytest.approx(2 / 3), 4.0: 0.0}
    censor = sv.km_curve(rows, censor=True)
    probes = spark.createDataFrame([(3 * HOUR,)], "time_us long")
    assert sv.curve_asof(censor, probes, left=True).first()["survival"] == 1.0
    assert sv.curve_asof(censor, probes).first()["survival"] == pytest.approx(0.5)


@pytest.mark.parametrize("bucket", [HOUR // 12, HOUR * 24, 1])
def test_bucketed_curves_equal_a_direct_product(spark, bucket):
    source = random.Random(11)
    rows = [(source.choice([1.0, 5.5, round(source.uniform(0.1, 160), 2)]), source.random() < 0.7, source.choice("PQ")) for _ in range(300)]
    curve = {(r["priority"], r["time_us"]): r["survival"] for r in sv.km_curve(durations(spark, rows), ["priority"], bucket=bucket).collect()}
    for priority in "PQ":
        mine, value = [(int(d * HOUR), e) for d, e, p in rows if p == priority], 1.0
        for time in sorted({d for d, _ in mine}):
            gone = sum(d == time and e for d, e in mine)
            value *= 1 - gone / sum(d >= time for d, _ in mine)
            if gone:
                assert curve[priority, time] == pytest.approx(value)
    whole = sv.km_curve(durations(spark, rows), bucket=bucket)
    steps = {r["time_us"]: r["survival"] for r in whole.collect()}
    asked = sorted({int(d * HOUR) for d, _, _ in rows} | {0, 999 * HOUR})
    probes = spark.createDataFrame([(t,) for t in asked], "time_us long")
    for left in (False, True):
        found = {r["time_us"]: r["survival"] for r in sv.curve_asof(whole, probes, left=left, bucket=bucket).collect()}
        for t in asked:
            assert found[t] == min([s for u, s in steps.items() if (u < t if left else u <= t)], default=1.0)


def test_constant_hazard(spark):
    coefficients = spark.createDataFrame([("", "", math.log(0.1))], "feature string, value string, coefficient double")
    profile = spark.createDataFrame([("x",) * 6], ", ".join(f"{n} string" for n in sv.FEATURES))
    rates = sv.hazard_rates(profile, coefficients)
    row = rates.select(sv.hazard_survival(F.lit(10.0)).alias("s"), sv.hazard_median().alias("m")).first()
    assert row["s"] == pytest.approx(math.exp(-1)) and row["m"] == pytest.approx(math.log(2) / 0.1)
    slow = spark.createDataFrame([("", "", math.log(1e-4))], "feature string, value string, coefficient double")
    assert sv.hazard_rates(profile, slow).select(sv.hazard_median().alias("m")).first()["m"] is None


def cohort_rows(spark, n=500):
    source = random.Random(3)
    rows = []
    for i in range(n):
        p = source.choice(["1", "2", "3"])
        d = min(168.0, source.expovariate(0.02 * int(p)))
        rows.append((f"I{i}", d, int(d * HOUR), source.random() < 0.8, p, source.choice("ab"), source.choice("cd"), str(i % 7), str(i % 4), "0–1 h"))
    return spark.createDataFrame(rows, "incident_id string, duration double, duration_us long, event boolean, "
                                 + ", ".join(f"{n} string" for n in sv.FEATURES))


def test_hazard_fit_equals_newtons_method(spark):
    rows = cohort_rows(spark)
    fitted = {(r["feature"], r["value"]): r["coefficient"] for r in sv.fit_hazard(rows).collect()}
    names = [*sv.FEATURES, "interval"]
    periods = sv.person_periods(rows).collect()
    levels = [key for key in fitted if key[0]]
    x = np.array([[1.0] + [float(r[f] == v) for f, v in levels] for r in periods])
    exposure, events = np.array([r["exposure"] for r in periods]), np.array([r["resolved"] for r in periods])
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(events.sum() / exposure.sum())
    penalty = np.full(len(beta), sv.ALPHA * exposure.sum())
    penalty[0] = 0
    for _ in range(50):
        mu = exposure * np.exp(x @ beta)
        beta -= np.linalg.solve(x.T @ (x * mu[:, None]) + np.diag(penalty), x.T @ (mu - events) + penalty * beta)
    assert fitted["", ""] == pytest.approx(beta[0], abs=1e-5)
    assert np.allclose([fitted[key] for key in levels], beta[1:], atol=1e-5)
    assert set(f for f, _ in levels) == set(names)


def test_end_of_horizon_censoring_is_evaluable(spark):
    rows = durations(spark, [(168, False, "P")])
    survival = spark.createDataFrame([(h, 0.8) for h in sv.HORIZONS], "hours int, survival double")
    censor = spark.createDataFrame([(168 * HOUR, 0.0)], "time_us long, survival double")
    scores = {r["hours"]: r for r in sv.ipcw_brier(rows, survival, [], censor).collect()}
    assert scores[168]["ipcw_brier"] == pytest.approx(0.04) and scores[168]["known_outcomes"] == 1


def test_untrained_priority_uses_the_pooled_curve_and_eventless_ones_stay_at_one(spark):
    train = durations(spark, [(2, True, "P"), (3, True, "P"), (4, False, "Q")])
    asked = durations(spark, [(1, True, p) for p in "PQR"])
    curve, pooled = sv.km_curve(train, ["priority"]), sv.km_curve(train)
    table = {(r["priority"], r["hours"]): r["survival"] for r in sv.baseline_tables(asked, train, curve, pooled).collect()}
    assert (table["P", 4], table["Q", 4], table["R", 4]) == (0.0, 1.0, pytest.approx(1 / 3))
    medians = {r["priority"]: r["median"] for r in sv.baseline_medians(asked, train, curve, pooled).collect()}
    assert medians == {"P": 2.0, "Q": None, "R": 3.0}


def test_cohort_does_not_look_past_the_observation_end(spark):
    start = datetime(2016, 3, 1)
    rows = [("INC1", start, start + timedelta(days=d), s, p, "Phone", "C", i, i, f"e{i}")
            for i, (d, s, p) in enumerate([(0, "New", "P1"), (1, "Active", "P2"), (31, "Resolved", "P3")])]
    events = spark.createDataFrame(rows, "incident_id string, opened_at timestamp_ntz, updated_at timestamp_ntz, state string, priority string, "
                                   "contact_type string, category string, source_row int, sys_mod_count int, event_id string")
    row = sv.cohort(sv.candidates(events, "2016-03-01", "2016-04-01", "2016-03-31 23:59:59")).first()
    assert (row["event"], row["duration"], row["priority"]) == (False, 24.0, "P1")


def test_hazard_fit_has_no_limit_on_levels_and_needs_no_events(spark):
    rows = cohort_rows(spark).withColumn("category", F.concat("category", (F.abs(F.hash("incident_id")) % 3).cast("string")))
    many = spark.range(20_000).select(
        F.concat(F.lit("I"), "id").alias("incident_id"), (1.0 + F.col("id") % 50).alias("duration"), ((1 + F.col("id") % 50) * HOUR).alias("duration_us"),
        (F.col("id") % 3 > 0).alias("event"), F.lit("P").alias("priority"), F.lit("c").alias("contact_type"),
        F.when(F.col("id") % 500 == 0, F.lit(None)).otherwise((F.col("id") % 10_000).cast("string")).alias("category"),
        F.lit("1").alias("weekday"), (F.col("id") % 4).cast("string").alias("hour_band"), F.lit("0–1 h").alias("age_band"))
    fit = sv.fit_hazard(many)
    assert fit.count() > 9_900
    worst = sv.fitted_events(many, fit).agg(F.max(F.abs(F.col("events") - F.col("fitted")))).first()[0]
    assert worst < 0.01
    none = sv.fit_hazard(rows.withColumn("event", F.lit(False))).collect()
    assert {r["coefficient"] for r in none if r["feature"]} == {0.0} and [r["coefficient"] for r in none if not r["feature"]] == [-30.0]


def test_all_splits_come_from_one_scan_and_one_exchange(spark):
    start = datetime(2016, 3, 1)
    source = random.Random(4)
    rows = [(f"INC{0 if i % 3 == 0 else source.randrange(40)}", start, start + timedelta(hours=source.randrange(500)), source.choice(["New", "Active", "Resolved"]),
             f"P{i % 4}", "Phone", "C", i, i % 5, f"e{i}") for i in range(900)]
    events = spark.createDataFrame(rows, "incident_id string, opened_at timestamp_ntz, updated_at timestamp_ntz, state string, priority string, "
                                   "contact_type string, category string, source_row int, sys_mod_count int, event_id string")
    splits = {"a": ("2016-03-01", "2016-03-05", "2016-03-08"), "b": ("2016-03-05", "2016-03-12", "2016-03-22")}
    found = sv.split_candidates(events, splits)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning(incident_id") == 2
    together = sorted(map(repr, found.collect()))
    apart = [r for name, split in splits.items() for r in sv.candidates(events, *split).withColumn("split", F.lit(name)).select(found.columns).collect()]
    assert together == sorted(map(repr, apart))
    want = {}
    for name, (a, b, observed) in splits.items():
        by = {}
        for r in sorted((r for r in rows if str(r[2]) <= f"{observed} 00:00:00"), key=lambda r: (r[2], r[8], r[7], r[9])):
            by.setdefault(r[0], []).append(r)
        for incident, mine in by.items():
            if datetime.fromisoformat(a) <= mine[0][2] < datetime.fromisoformat(b):
                closed = min((r[2] for r in mine if r[3] == "Resolved"), default=None)
                want[name, incident] = (mine[0][2], closed is not None and closed - mine[0][2] <= timedelta(hours=168), mine[0][4])
    assert {(r["split"], r["incident_id"]): (r["origin"], r["event"], r["priority"]) for r in found.collect()} == want
