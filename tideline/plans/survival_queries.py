"""Queries of the time-to-resolution study: cohorts, curves, hazards, evaluation."""
from pyspark.sql import functions as F

from tideline.operators import survival as sv
from tideline.plans.audit import AUDIT_SQL, audit_columns
from tideline.plans.registry import query, rounded
from tideline.session import materialize, read_table

# (start, end, last observation) of each split.
SPLITS = {"train": ("2024-01-01 00:00:00", "2024-01-16 00:00:00", "2024-01-15 23:59:59"),
          "validation": ("2024-01-16 00:00:00", "2024-01-23 00:00:00", "2024-01-22 23:59:59"),
          "test": ("2024-01-23 00:00:00", "2024-01-31 00:00:00", "2024-01-31 00:00:00")}


def user_days(spark, sf_dir):
    """One incident per user and day, opened at midnight (a day earlier for every tenth user)."""
    events = read_table(spark, sf_dir, "events")
    columns = audit_columns(events)
    midnight = F.to_date("ts").cast("timestamp_ntz")
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("INC"), (F.col("user_id") * 100 + F.dayofmonth("ts")).cast("string")).alias("incident_id"),
        F.when(F.col("user_id") % 10 == 0, midnight - F.expr("INTERVAL 1 DAY")).otherwise(midnight).alias("opened_at"),
        *[column.alias(name) for name, column in columns.items()])


def found(spark, sf_dir):
    """Candidates of all splits from one pass over the log."""
    return sv.split_candidates(user_days(spark, sf_dir), SPLITS)


def cohorts(spark, sf_dir):
    """``{split: cohort}``, stored: every curve and score reads a cohort several times."""
    stored = materialize(sv.cohort(found(spark, sf_dir)), "cohorts")
    return {name: stored.filter(F.col("split") == name).drop("split") for name in SPLITS}


def cohort(spark, sf_dir, split):
    return cohorts(spark, sf_dir)[split]


COHORT_SQL = AUDIT_SQL + """, days AS (
  SELECT *, e.user_id, 'INC' || CAST(e.user_id * 100 + day(a.updated_at) AS VARCHAR) AS incident,
    CAST(a.updated_at AS DATE) - CASE WHEN e.user_id % 10 = 0 THEN 1 ELSE 0 END AS open_day,
    a.state IN ('Resolved', 'Closed') AS terminal FROM audit a JOIN events e ON e.event_id + 2 = a.source_row),
splits(split, a, b, observed) AS (VALUES """ + ", ".join(
    f"('{name}', TIMESTAMP '{a}', TIMESTAMP '{b}', TIMESTAMP '{o}')" for name, (a, b, o) in SPLITS.items()) + """),
firsts AS (
  SELECT split, incident, min_by(terminal, o) AS first_terminal, min_by(updated_at, o) AS origin, min_by(open_day, o) AS open_day,
    min_by(priority, o) AS priority, min_by(contact_type, o) AS contact_type, min_by(category, o) AS category,
    min(CASE WHEN terminal THEN updated_at END) AS closed_at, max(updated_at) AS last_at, any_value(a) AS a, any_value(b) AS b
  FROM (SELECT s.split, s.a, s.b, d.*, row_number() OVER (PARTITION BY split, incident ORDER BY updated_at, sys_mod_count, source_row) AS o
    FROM days d JOIN splits s ON d.updated_at <= s.observed) GROUP BY split, incident),
aged AS (SELECT *, date_diff('microsecond', CAST(open_day AS TIMESTAMP), origin) / 3.6e9 AS age,
    date_diff('microsecond', origin, coalesce(closed_at, last_at)) AS follow FROM firsts WHERE origin >= a AND origin < b),
labelled AS (SELECT split, incident AS incident_id, origin, least(follow, 168 * 3600000000) AS duration_us, closed_at IS NOT NULL AND follow <= 168 * 3600000000 AS event,
    priority, contact_type, category, CAST(isodow(origin) - 1 AS VARCHAR) AS weekday, CAST(CAST(floor(hour(origin) / 6.0) AS INTEGER) AS VARCHAR) AS hour_band,
    CASE WHEN age <= 1 THEN '0–1 h' ELSE '1–24 h' END AS age_band,
    CASE WHEN first_terminal THEN 'first_already_terminal' WHEN age < 0 OR age > 24 THEN 'delayed_first_observation'
      WHEN follow <= 0 THEN 'no_followup' END AS exclusion FROM aged),
members AS (SELECT * EXCLUDE (exclusion), duration_us / 3.6e9 AS duration FROM labelled WHERE exclusion IS NULL)"""


def curve_sql(name, source, strata="", happened="event"):
    """Kaplan-Meier curve from distinct times with sums over later and products over earlier rows."""
    by = f"{strata}, " if strata else ""
    part = f"PARTITION BY {strata} " if strata else ""
    return f""", {name}_n AS (SELECT {by}duration_us AS time_us, count(*) AS n, count(*) FILTER (WHERE {happened}) AS events FROM {source} GROUP BY ALL),
{name}_r AS (SELECT *, CAST(sum(n) OVER ({part}ORDER BY time_us DESC) AS BIGINT) AS at_risk FROM {name}_n),
{name} AS (SELECT {by}time_us, time_us / 3.6e9 AS time, at_risk, events,
    product(1 - events / CAST(at_risk AS DOUBLE)) OVER ({part}ORDER BY time_us ROWS UNBOUNDED PRECEDING) AS survival FROM {name}_r WHERE events > 0)"""


TRAIN_SQL = "WITH " + COHORT_SQL + ", train AS (SELECT * FROM members WHERE split = 'train'), validation AS (SELECT * FROM members WHERE split = 'validation'), test AS (SELECT * FROM members WHERE split = 'test')"
CURVES_SQL = (TRAIN_SQL + curve_sql("pooled", "train") + curve_sql("by_priority", "train", "priority")
              + curve_sql("censor", "train", happened="NOT event"))


@query("q_survival_cohort", "WITH " + COHORT_SQL + """ SELECT split, incident_id, origin, duration_us, round(duration, 6) AS duration, event, priority, contact_type,
  category, weekday, hour_band, age_band FROM members""")
def survival_cohort(spark, sf_dir):
    return rounded(sv.cohort(found(spark, sf_dir)))


@query("q_cohort_exclusions", "WITH " + COHORT_SQL + """
SELECT split, exclusion, count(*) AS incidents FROM labelled WHERE exclusion IS NOT NULL GROUP BY 1, 2""")
def cohort_exclusions(spark, sf_dir):
    return sv.exclusions(found(spark, sf_dir), by=["split"])


@query("q_split_membership", "WITH " + COHORT_SQL + " SELECT incident_id, split FROM members")
def split_membership(spark, sf_dir):
    return sv.cohort(found(spark, sf_dir)).select("incident_id", "split")


@query("q_split_overlap", "WITH " + COHORT_SQL + """, twice AS (SELECT incident_id, split FROM members
  UNION ALL SELECT incident_id, 'test' FROM members WHERE split = 'train' AND priority = '1 - Critical')
SELECT incident_id, min(split) AS one, max(split) AS other FROM twice GROUP BY 1 HAVING min(split) <> max(split)""")
def split_overlap(spark, sf_dir):
    """Some training incidents are smuggled into the test split; exactly those must be reported."""
    splits = cohorts(spark, sf_dir)
    splits["test"] = splits["test"].unionByName(splits["train"].filter("priority = '1 - Critical'"))
    return sv.split_overlap(sv.split_membership(splits))


CURVE_COLUMNS = "time_us, round(time, 6) AS time, at_risk, events, round(survival, 6) AS survival"


@query("q_km_curve", TRAIN_SQL + curve_sql("pooled", "train") + f" SELECT {CURVE_COLUMNS} FROM pooled")
def km_curve(spark, sf_dir):
    return rounded(sv.km_curve(cohort(spark, sf_dir, "train")))


@query("q_km_priority", TRAIN_SQL + curve_sql("by_priority", "train", "priority") + f" SELECT priority, {CURVE_COLUMNS} FROM by_priority")
def km_priority(spark, sf_dir):
    return rounded(sv.km_curve(cohort(spark, sf_dir, "train"), ["priority"]))


@query("q_km_censor", TRAIN_SQL + curve_sql("censor", "train", happened="NOT event") + f" SELECT {CURVE_COLUMNS} FROM censor")
def km_censor(spark, sf_dir):
    return rounded(sv.km_curve(cohort(spark, sf_dir, "train"), censor=True))


@query("q_curve_asof", CURVES_SQL + """, probes AS (SELECT DISTINCT duration_us AS time_us FROM validation UNION SELECT time_us FROM censor)
SELECT time_us, round(coalesce((SELECT min(survival) FROM censor c WHERE c.time_us <= p.time_us), 1), 6) AS at_or_before,
  round(coalesce((SELECT min(survival) FROM censor c WHERE c.time_us < p.time_us), 1), 6) AS before FROM probes p""")
def curve_asof(spark, sf_dir):
    """The censoring curve looked up at every validation duration and at its own steps, both ways."""
    curve = materialize(sv.km_curve(cohort(spark, sf_dir, "train"), censor=True), "censor")
    probes = (cohort(spark, sf_dir, "validation").select(F.col("duration_us").alias("time_us"))
              .unionByName(curve.select("time_us")).distinct())
    reached = sv.curve_asof(curve, probes).withColumnRenamed("survival", "at_or_before")
    return rounded(reached.join(sv.curve_asof(curve, probes, left=True).withColumnRenamed("survival", "before"), "time_us"))


@query("q_person_periods", TRAIN_SQL + """, bins(i, a, b) AS (VALUES (0, 0, 1), (1, 1, 4), (2, 4, 12), (3, 12, 24), (4, 24, 48), (5, 48, 72), (6, 72, 168))
SELECT incident_id, CAST(i AS VARCHAR) AS interval, round(least(duration, b) - a, 6) AS exposure,
  CAST(CASE WHEN event AND duration <= b THEN 1 ELSE 0 END AS INTEGER) AS resolved FROM train JOIN bins ON duration > a""")
def person_periods(spark, sf_dir):
    return rounded(sv.person_periods(cohort(spark, sf_dir, "train")).select("incident_id", "interval", "exposure", "resolved"))


@query("q_training_support", TRAIN_SQL + "".join(
    f" {'SELECT' if i == 0 else 'UNION ALL SELECT'} '{name}' AS feature, {name} AS value, count(*) AS rows, (SELECT count(*) FROM train) AS training_n, "
    f"(SELECT count(*) FROM train WHERE event) AS observed_events FROM train GROUP BY {name}" for i, name in enumerate(sv.FEATURES)))
def training_support(spark, sf_dir):
    return sv.training_support(cohort(spark, sf_dir, "train"))


@query("q_category_drift", TRAIN_SQL + ", shares AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS feature, coalesce(a.v, b.v) AS value, coalesce(a.n, 0) / CAST((SELECT count(*) FROM train) AS DOUBLE) AS p, "
    f"coalesce(b.n, 0) / CAST((SELECT count(*) FROM test) AS DOUBLE) AS q FROM (SELECT {name} AS v, count(*) AS n FROM train GROUP BY 1) a "
    f"FULL JOIN (SELECT {name} AS v, count(*) AS n FROM test GROUP BY 1) b ON a.v = b.v" for name in sv.FIELDS) + """)
SELECT feature, round(0.5 * sum(abs(p - q)), 6) AS total_variation, round(sum(CASE WHEN p = 0 THEN q ELSE 0.0 END), 6) AS unseen_test_fraction
FROM shares GROUP BY feature""")
def category_drift(spark, sf_dir):
    splits = cohorts(spark, sf_dir)
    return rounded(sv.category_drift(splits["train"], splits["test"]))


class Baselines:
    """Training curves stored once, with the tables the evaluation needs."""

    def __init__(self, spark, sf_dir):
        self.splits = cohorts(spark, sf_dir)
        self.train = self.splits["train"]
        self.pooled = materialize(sv.km_curve(self.train), "pooled")
        self.priority = materialize(sv.km_curve(self.train, ["priority"]), "priority")
        self.censor = materialize(sv.km_curve(self.train, censor=True), "censor")

    def survival(self, rows, candidate, coefficients=None):
        """``(keys, survival table)`` of a candidate for the profiles of ``rows``."""
        if candidate == "global_median":
            return [], sv.curve_at_hours(self.pooled)
        if candidate == "priority_median":
            return ["priority"], sv.baseline_tables(rows, self.train, self.priority, self.pooled)
        profiles = rows.select(*sv.FEATURES).distinct()
        return list(sv.FEATURES), sv.hazard_at_hours(sv.hazard_rates(profiles, coefficients))

    def medians(self, rows, candidate, coefficients=None):
        if candidate == "global_median":
            return [], sv.curve_median(self.pooled)
        if candidate == "priority_median":
            return ["priority"], sv.baseline_medians(rows, self.train, self.priority, self.pooled)
        profiles = sv.hazard_rates(rows.select(*sv.FEATURES).distinct(), coefficients)
        return list(sv.FEATURES), profiles.select(*sv.FEATURES, sv.hazard_median().alias("median"))

    def brier(self, rows, candidate, coefficients=None, by=()):
        keys, table = self.survival(rows, candidate, coefficients)
        return sv.ipcw_brier(rows, table, keys, self.censor, by)


# ---- a hazard model with stated coefficients, so that everything behind the fit has a statement in SQL -----------

def stated_coefficients(train):
    """A coefficient for every level of the training cohort, by a formula of its last character, and an intercept of -3."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in sv.FEATURES]))
    levels = train.select(pairs.alias("p")).select("p.*").distinct()
    bins = train.sparkSession.createDataFrame([("interval", str(i)) for i in range(len(sv.BINS) - 1)], "feature string, value string")
    stated = levels.unionByName(bins).withColumn("coefficient", ((F.ascii(F.right("value", F.lit(1))) % 7) - 3) / 10)
    return stated.unionByName(train.sparkSession.createDataFrame([("", "", -3.0)], "feature string, value string, coefficient double"))


_BINS = list(enumerate(zip(sv.BINS, sv.BINS[1:], strict=False)))
ETA_SQL = "-3.0 + " + " + ".join(f"CASE WHEN {n} IN (SELECT {n} FROM train) THEN (ascii(right({n}, 1)) % 7 - 3) / 10.0 ELSE 0 END" for n in sv.FEATURES)


def rate_sql(i):
    return f"exp(least(10.0, greatest(-30.0, eta + {((48 + i) % 7 - 3) / 10})))"


def hazard_sql(hours):
    return "(" + " + ".join(f"{rate_sql(i)} * greatest(0.0, least({hours}, {b}.0) - {a}.0)" for i, (a, b) in _BINS) + ")"


HAZARD_MEDIAN_SQL = "CASE " + " ".join(f"WHEN {hazard_sql(f'{b}.0')} >= ln(2) THEN {a} + (ln(2) - {hazard_sql(f'{a}.0')}) / {rate_sql(i)}" for i, (a, b) in _BINS) + " END"
EVALUATED = ("validation", "test")
CANDIDATES = ("global_median", "priority_median", "piecewise_hazard")

BRIER_SQL = CURVES_SQL + f""", hours AS (SELECT unnest([4, 12, 24, 48, 72, 168]) AS h),
support AS (SELECT h, coalesce(min(survival) FILTER (WHERE time_us < h * 3600000000), 1) AS g FROM hours, censor GROUP BY h),
own AS (SELECT v.*, coalesce((SELECT min(survival) FROM censor c WHERE c.time_us < v.duration_us), 1) AS g_own, {ETA_SQL} AS eta FROM members v WHERE split <> 'train'),
predicted AS (
  SELECT 'global_median' AS candidate, h, o.*, coalesce((SELECT min(survival) FROM pooled p WHERE p.time_us <= h * 3600000000), 1) AS s FROM own o, hours
  UNION ALL SELECT 'priority_median', h, o.*, CASE WHEN o.priority IN (SELECT priority FROM train)
      THEN coalesce((SELECT min(survival) FROM by_priority p WHERE p.priority = o.priority AND p.time_us <= h * 3600000000), 1)
      ELSE coalesce((SELECT min(survival) FROM pooled p WHERE p.time_us <= h * 3600000000), 1) END FROM own o, hours
  UNION ALL SELECT 'piecewise_hazard', h, o.*, exp(-{hazard_sql('h')}) FROM own o, hours),
losses AS (SELECT split, candidate, p.h, priority, g, CASE WHEN event AND duration_us <= p.h * 3600000000 THEN s * s / g_own
    WHEN duration_us > p.h * 3600000000 OR (duration_us = p.h * 3600000000 AND NOT event) THEN (1 - s) * (1 - s) / g END AS loss
  FROM predicted p JOIN support u ON u.h = p.h)"""
SCORES_SQL = """count(*) AS n, CASE WHEN any_value(g) >= 0.05 THEN round(sum(coalesce(loss, 0)) / count(*), 6) END AS ipcw_brier,
  CASE WHEN any_value(g) >= 0.05 THEN count(loss) ELSE 0 END AS known_outcomes"""


def evaluated(base, score):
    """``score(rows, candidate, coefficients)`` of all three candidates on both later splits."""
    coefficients = materialize(stated_coefficients(base.train), "stated")
    parts = [score(base.splits[split], name, coefficients).withColumns({"split": F.lit(split), "candidate": F.lit(name)}) for split in EVALUATED for name in CANDIDATES]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query("q_ipcw_brier", BRIER_SQL + f" SELECT split, candidate, CAST(h AS INTEGER) AS hours, {SCORES_SQL} FROM losses GROUP BY split, candidate, h")
def ipcw_brier(spark, sf_dir):
    return rounded(evaluated(base := Baselines(spark, sf_dir), base.brier))


@query("q_brier_by_priority", BRIER_SQL + f""" SELECT split, priority, candidate, CAST(h AS INTEGER) AS hours, {SCORES_SQL} FROM losses GROUP BY split, priority, candidate, h""")
def brier_by_priority(spark, sf_dir):
    base = Baselines(spark, sf_dir)
    return rounded(evaluated(base, lambda rows, name, coefficients: base.brier(rows, name, coefficients, by=["priority"])))


@query("q_median_mae", CURVES_SQL + f""", p AS (SELECT min(time) FILTER (WHERE survival <= 0.5) AS m FROM pooled),
q AS (SELECT priority, min(time) FILTER (WHERE survival <= 0.5) AS m FROM by_priority GROUP BY 1), v AS (SELECT *, {ETA_SQL} AS eta FROM members WHERE split <> 'train'),
rows AS (SELECT 'global_median' AS candidate, v.*, m FROM v, p
  UNION ALL SELECT 'priority_median', v.*, CASE WHEN v.priority IN (SELECT priority FROM train) THEN q.m ELSE p.m END FROM v CROSS JOIN p LEFT JOIN q ON q.priority = v.priority
  UNION ALL SELECT 'piecewise_hazard', v.*, {HAZARD_MEDIAN_SQL} FROM v)
SELECT split, candidate, count(*) AS n, count(*) FILTER (WHERE event) AS resolved_within_168h, count(*) FILTER (WHERE NOT event AND duration < 168) AS censored_before_168h,
  round(avg(CASE WHEN event THEN abs(coalesce(m, 168) - duration) END), 6) AS observed_event_median_mae_hours FROM rows GROUP BY split, candidate""")
def median_mae(spark, sf_dir):
    base = Baselines(spark, sf_dir)

    def score(rows, name, coefficients):
        keys, medians = base.medians(rows, name, coefficients)
        return sv.median_mae(rows, medians, keys)
    return rounded(evaluated(base, score))


PROFILES_SQL = TRAIN_SQL + f", profiles AS (SELECT DISTINCT {', '.join(sv.FEATURES)}, {ETA_SQL} AS eta FROM validation)"


def stated_profiles(spark, sf_dir):
    splits = cohorts(spark, sf_dir)
    return sv.hazard_rates(splits["validation"].select(*sv.FEATURES).distinct(), stated_coefficients(splits["train"]))


@query("q_hazard_survival_stated", PROFILES_SQL + f""" SELECT {', '.join(sv.FEATURES)}, CAST(h AS INTEGER) AS hours, round(exp(-{hazard_sql('h')}), 6) AS survival
FROM profiles, (SELECT unnest([4, 12, 24, 48, 72, 168]) AS h)""")
def hazard_survival_stated(spark, sf_dir):
    return rounded(sv.hazard_at_hours(stated_profiles(spark, sf_dir)))


@query("q_median_time_stated", PROFILES_SQL + f" SELECT {', '.join(sv.FEATURES)}, round({HAZARD_MEDIAN_SQL}, 6) AS median FROM profiles")
def median_time_stated(spark, sf_dir):
    return rounded(stated_profiles(spark, sf_dir).select(*sv.FEATURES, sv.hazard_median().alias("median")))


@query("q_survival_selection_stated", BRIER_SQL + """, scores AS (SELECT candidate, h, CASE WHEN any_value(g) >= 0.05 THEN sum(coalesce(loss, 0)) / count(*) END AS b
  FROM losses WHERE split = 'validation' GROUP BY candidate, h),
wide AS (SELECT avg(b) FILTER (WHERE candidate = 'global_median') AS g, avg(b) FILTER (WHERE candidate = 'priority_median') AS p,
  avg(b) FILTER (WHERE candidate = 'piecewise_hazard') AS z FROM scores)
SELECT CASE WHEN g <= p THEN 'global_median' ELSE 'priority_median' END AS baseline,
  CASE WHEN z < 0.98 * least(g, p) THEN 'piecewise_hazard' WHEN g <= p THEN 'global_median' ELSE 'priority_median' END AS selected_model FROM wide""")
def survival_selection_stated(spark, sf_dir):
    base = Baselines(spark, sf_dir)
    return selected(base, stated_coefficients(base.train))


@query("q_scenario_curves_stated", TRAIN_SQL + f""", one AS (SELECT {', '.join(f'min({n}) AS {n}' for n in sv.FEATURES if n != 'priority')} FROM train),
two AS (SELECT *, {ETA_SQL} AS eta FROM one, (VALUES ('1 - Critical'), ('3 - Moderate')) t(priority))
SELECT priority, CAST(h AS INTEGER) AS hours, round(exp(-{hazard_sql('h')}), 6) AS survival FROM two, (SELECT unnest(generate_series(0, 168)) AS h)""")
def scenario_curves_stated(spark, sf_dir):
    train = cohort(spark, sf_dir, "train")
    return scenarios(train, stated_coefficients(train))


# ---- hazard model: iterative fit, checked against Newton's method in the tests ------------------------------

@query("q_hazard_fit", TRAIN_SQL + """, bins(i, a, b) AS (VALUES (0, 0, 1), (1, 1, 4), (2, 4, 12), (3, 12, 24), (4, 24, 48), (5, 48, 72), (6, 72, 168)),
cells AS (SELECT t.*, CAST(i AS VARCHAR) AS interval, CASE WHEN event AND duration <= b THEN 1 ELSE 0 END AS resolved FROM train t JOIN bins ON duration > a),
sums AS (SELECT '' AS feature, '' AS value, sum(resolved) AS n FROM cells """ + " ".join(
    f"UNION ALL SELECT '{name}', {name}, sum(resolved) FROM cells GROUP BY {name}" for name in (*sv.FEATURES, "interval")) + """)
SELECT feature, value, CAST(n AS BIGINT) AS events, round(CAST(n AS DOUBLE), 3) AS fitted FROM sums""")
def hazard_fit(spark, sf_dir):
    """At the optimum every level's fitted events (with its penalty) equal its observed ones, which the statement counts."""
    train = cohort(spark, sf_dir, "train")
    return sv.fitted_events(train, sv.fit_hazard(train)).withColumn("fitted", F.round("fitted", 3) + 0.0)


@query("q_hazard_survival")
def hazard_survival(spark, sf_dir):
    coefficients = sv.fit_hazard(cohort(spark, sf_dir, "train"))
    profiles = cohort(spark, sf_dir, "validation").select(*sv.FEATURES).distinct()
    return rounded(sv.hazard_at_hours(sv.hazard_rates(profiles, coefficients)))


@query("q_median_time")
def median_time(spark, sf_dir):
    coefficients = sv.fit_hazard(cohort(spark, sf_dir, "train"))
    profiles = sv.hazard_rates(cohort(spark, sf_dir, "validation").select(*sv.FEATURES).distinct(), coefficients)
    return rounded(profiles.select(*sv.FEATURES, sv.hazard_median().alias("median")))


def selected(base, coefficients):
    rows = base.splits["validation"]
    parts = [sv.mean_brier(base.brier(rows, name, coefficients)).withColumn("candidate", F.lit(name)) for name in CANDIDATES]
    return sv.select_candidate(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def scenarios(train, coefficients):
    """Critical against moderate over a week, other inputs at their first training value."""
    rest = train.agg(*[F.min(name).alias(name) for name in sv.FEATURES if name != "priority"])
    profiles = rest.withColumn("priority", F.explode(F.array(F.lit("1 - Critical"), F.lit("3 - Moderate"))))
    return rounded(sv.scenario_curves(sv.hazard_rates(profiles, coefficients)).select("priority", "hours", "survival"))


@query("q_survival_selection")
def survival_selection(spark, sf_dir):
    base = Baselines(spark, sf_dir)
    return selected(base, sv.fit_hazard(base.train))


@query("q_scenario_curves")
def scenario_curves(spark, sf_dir):
    train = cohort(spark, sf_dir, "train")
    return scenarios(train, sv.fit_hazard(train))
