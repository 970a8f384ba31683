"""Censor-aware time to resolution: cohorts, Kaplan-Meier curves, piecewise hazards and their evaluation.

Durations are kept as whole microseconds where they are keys. Curves are built and looked up in time buckets with a
carry per bucket, so a pooled curve over very many distinct durations is not one task's work.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions.timecols import MICROS_PER_HOUR, hours_between, micros_between, ntz
from tideline.operators.history import ORDER
from tideline.operators.normalize import is_terminal
from tideline.operators.segments import cumulative

BINS = (0, 1, 4, 12, 24, 48, 72, 168)
HORIZONS = (4, 12, 24, 48, 72, 168)
LIMIT_HOURS = 168
FIELDS = ("priority", "contact_type", "category")
FEATURES = FIELDS + ("weekday", "hour_band", "age_band")
SUPPORT_FLOOR = 0.05
ALPHA = 1e-4
HOUR = int(MICROS_PER_HOUR)
BUCKET = HOUR // 12


def first_observations(events, ends):
    """One row per incident: its first row by ``ORDER`` (as ``first``), first terminal time, and the last time up to each of ``ends`` (``{name: time}``).

    One scan and one exchange of the rows, whatever the number of observation ends. Rows are sorted inside hours of an incident; measures are taken over the
    whole hour and its first row stays with its payload. The same again over one row an hour, so a hot incident is not one task's work.
    """
    segment = F.date_diff(F.to_date("updated_at"), F.lit("1970-01-01").cast("date")) * 24 + F.hour("updated_at")
    latest = max(str(end) for end in ends.values())
    kept = list(dict.fromkeys([*ORDER, "state", "opened_at", *FIELDS]))
    seen = events.filter(F.col("updated_at") <= ntz(latest)).select("incident_id", *kept, segment.alias("segment"))
    closed = F.when(is_terminal(F.col("state")), F.col("updated_at"))
    inside = Window.partitionBy("incident_id", "segment")
    measures = {"closed_at": F.min(closed)} | {f"last_{name}": F.max(F.when(F.col("updated_at") <= ntz(end), F.col("updated_at"))) for name, end in ends.items()}
    hours = (seen.withColumns({"place": F.row_number().over(inside.orderBy(*ORDER)), **{name: measure.over(inside) for name, measure in measures.items()}})
             .filter("place = 1").select("incident_id", "segment", F.struct(*kept).alias("first"), *measures))
    whole = Window.partitionBy("incident_id")
    again = {name: (F.min if name == "closed_at" else F.max)(name).over(whole) for name in measures}
    return (hours.withColumns({"place": F.row_number().over(whole.orderBy("segment")), **again}).filter("place = 1").drop("place", "segment"))


def split_candidates(events, splits):
    """Incidents first seen in ``[start, end)`` of a split, with their exclusion reason (null when they qualify). ``splits``: ``{name: (start, end, observation end)}``."""
    rows = first_observations(events, {name: observed for name, (_, _, observed) in splits.items()})
    cells = F.array(*[F.struct(F.lit(name).alias("split"), ntz(start).alias("start"), ntz(end).alias("end"), ntz(observed).alias("observed"), F.col(f"last_{name}").alias("last_at"))
                      for name, (start, end, observed) in splits.items()])
    origin = F.col("first.updated_at")
    rows = rows.select("incident_id", "first", "closed_at", F.explode(cells).alias("s")).filter(
        (origin >= F.col("s.start")) & (origin < F.col("s.end")) & (origin <= F.col("s.observed")))
    closed = F.when(F.col("closed_at") <= F.col("s.observed"), F.col("closed_at"))
    age = hours_between(F.col("first.opened_at"), origin)
    follow = micros_between(origin, F.coalesce(closed, "s.last_at"))
    reason = (F.when(is_terminal(F.col("first.state")), "first_already_terminal")
              .when((age < 0) | (age > 24), "delayed_first_observation").when(follow <= 0, "no_followup"))
    limit = F.lit(LIMIT_HOURS * HOUR)
    return rows.select("s.split", "incident_id", origin.alias("origin"), F.least(follow, limit).alias("duration_us"),
                       (closed.isNotNull() & (follow <= limit)).alias("event"),
                       *[F.col(f"first.{name}").alias(name) for name in FIELDS],
                       F.weekday(origin).cast("string").alias("weekday"),
                       F.floor(F.hour(origin) / 6).cast("string").alias("hour_band"),
                       F.when(age <= 1, "0–1 h").otherwise("1–24 h").alias("age_band"), reason.alias("exclusion"))


def candidates(events, start, end, observation_end):
    """``split_candidates`` of one split."""
    return split_candidates(events, {"only": (start, end, observation_end)}).drop("split")


def cohort(found):
    return found.filter(F.col("exclusion").isNull()).drop("exclusion").withColumn(
        "duration", F.col("duration_us") / F.lit(MICROS_PER_HOUR))


def exclusions(found, by=()):
    return found.filter(F.col("exclusion").isNotNull()).groupBy(*by, "exclusion").agg(F.count("*").alias("incidents"))


def _product_so_far(rows, keys, bucket, order, factor, name):
    inside = Window.partitionBy(*keys, bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = (rows.groupBy(*keys, bucket).agg(F.product(F.col(factor)).alias("_all"))
             .withColumn("_carry", F.coalesce(F.product(F.col("_all")).over(across), F.lit(1.0))).drop("_all"))
    return (rows.withColumn("_in", F.product(F.col(factor)).over(inside)).join(carry, [*keys, bucket])
            .withColumn(name, F.col("_in") * F.col("_carry")).drop("_in", "_carry"))


def km_curve(rows, strata=(), censor=False, bucket=BUCKET):
    """Kaplan-Meier steps ``(strata…, time_us, at_risk, events, survival)``; ``censor`` estimates the censoring curve."""
    strata = list(strata)
    happened = ~F.col("event") if censor else F.col("event")
    counts = (rows.groupBy(*strata, F.col("duration_us").alias("time_us")).agg(
        F.count("*").alias("n"), F.count_if(happened).alias("events"))
        .withColumn("_bucket", F.floor(F.col("time_us") / bucket)))
    risk = cumulative(counts, strata, "time_us", "_bucket", "n", "at_risk", descending=True)
    steps = risk.filter("events > 0").withColumn("_factor", 1 - F.col("events") / F.col("at_risk"))
    curve = _product_so_far(steps, strata, "_bucket", "time_us", "_factor", "survival")
    return curve.select(*strata, "time_us", (F.col("time_us") / F.lit(MICROS_PER_HOUR)).alias("time"), "at_risk", "events", "survival")


def curve_asof(curve, probes, strata=(), left=False, bucket=BUCKET):
    """Curve value at each probe time: last step ``<= t`` (``< t`` with ``left``), 1 before the first step.

    A survival curve never rises, so "last value so far" is the running minimum, inside and across buckets.
    """
    strata = list(strata)
    at_curve, at_probe = (1, 0) if left else (0, 1)
    steps = curve.select(*strata, "time_us", "survival", F.lit(at_curve).alias("_tag"))
    asked = probes.select(*strata, "time_us", F.lit(None).cast("double").alias("survival"), F.lit(at_probe).alias("_tag")).distinct()
    both = steps.unionByName(asked).withColumn("_bucket", F.floor(F.col("time_us") / bucket))
    inside = Window.partitionBy(*strata, "_bucket").orderBy("time_us", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (both.groupBy(*strata, "_bucket").agg(F.min("survival").alias("_low"))
             .withColumn("_carry", F.min("_low").over(across)).drop("_low"))
    found = (both.withColumn("_in", F.min("survival").over(inside)).filter(F.col("_tag") == at_probe)
             .join(carry, [*strata, "_bucket"])
             .select(*strata, "time_us", F.coalesce(F.least("_in", "_carry"), F.lit(1.0)).alias("survival")))
    return probes.join(found, [*strata, "time_us"])


def curve_at_hours(curve, strata=(), hours=HORIZONS, left=False):
    """Curve at fixed hours ``(strata…, hours, survival)`` with one conditional aggregate per hour."""
    hit = (lambda h: F.col("time_us") < h * HOUR) if left else (lambda h: F.col("time_us") <= h * HOUR)
    cells = F.array(*[F.struct(F.lit(h).alias("hours"), F.coalesce(F.min(F.when(hit(h), F.col("survival"))), F.lit(1.0))
                               .alias("survival")) for h in hours])
    return curve.groupBy(*strata).agg(cells.alias("c")).select(*strata, F.explode("c").alias("c")).select(*strata, "c.*")


def curve_median(curve, strata=()):
    """First time with survival at most one half; null where the curve stays above."""
    return curve.groupBy(*strata).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def person_periods(rows):
    """One row per incident and bin it was exposed in: exposure, rate label and whether it resolved there."""
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(float(a)).alias("left"), F.lit(float(b)).alias("right"))
                               for i, (a, b) in enumerate(zip(BINS, BINS[1:]))]))
    spread = rows.select("*", bins.alias("b")).select(*rows.columns, "b.*")
    return (spread.withColumn("exposure", F.least("duration", "right") - F.col("left")).filter(F.col("exposure") > 0)
            .withColumn("resolved", (F.col("event") & (F.col("duration") <= F.col("right"))).cast("int"))
            .withColumn("rate", F.col("resolved") / F.col("exposure")).withColumn("interval", F.col("interval").cast("string"))
            .drop("left", "right"))


def hazard_cells(rows):
    """Exposure and events per distinct feature combination and bin: all that the likelihood needs."""
    return person_periods(rows).groupBy(*FEATURES, "interval").agg(F.sum("exposure").alias("exposure"), F.sum("resolved").alias("events"))


def fit_hazard(rows, alpha=ALPHA, tolerance=1e-7, steps=500):
    """Piecewise-exponential hazard as a ridge Poisson regression; returns ``(feature, value, coefficient)``.

    Minimises the sum of fitted events minus events times log rate over cells, plus ``alpha * exposure / 2`` times the squared coefficients (without the
    intercept), by L-BFGS scaled with the curvature at the start. Each step is one job: tasks add up gradients over their cells, sums per level are
    exchanged, and only the levels' sums reach the driver, which holds the coefficients. There is no limit on levels. Without any event the
    intercept is -30, the lowest log rate that ``hazard_rates`` uses, and all others are 0.
    """
    import numpy as np

    from tideline.session import materialize

    names, spark = [*FEATURES, "interval"], rows.sparkSession
    cells = materialize(hazard_cells(rows), "cells")
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names]))
    levels = [(r["feature"], r["value"]) for r in cells.select(pairs.alias("p")).select("p.*").distinct().orderBy("feature", "value").collect()]
    totals = cells.agg(F.sum("exposure").alias("exposure"), F.sum("events").alias("events")).first()

    def table(intercept, coefficients):
        found = [("", "", float(intercept)), *[(f, v, float(c)) for (f, v), c in zip(levels, coefficients, strict=True)]]
        return spark.createDataFrame(found, "feature string, value string, coefficient double")

    if not totals["events"]:
        return table(-30.0, np.zeros(len(levels)))
    numbered = spark.createDataFrame([(f, v, i + 1) for i, (f, v) in enumerate(levels)], "feature string, value string, place int")
    placed = cells
    for name in names:
        # Null levels are levels of their own.
        own = numbered.filter(F.col("feature") == name).select(F.col("value").alias("_v"), F.col("place").alias(f"{name}_place"))
        placed = placed.join(own, F.col(name).eqNullSafe(F.col("_v"))).drop("_v")
    placed = materialize(placed.select(F.array(*[f"{name}_place" for name in names]).alias("places"), "exposure", "events"), "placed")
    penalty = np.full(len(levels) + 1, alpha * totals["exposure"])
    penalty[0] = 0.0

    def evaluate(beta):
        """Objective, gradient and curvature per coefficient."""
        shared = spark.sparkContext.broadcast(beta)

        def partial(batches):
            import pandas as pd
            coefficients = shared.value
            gradient, curvature, loss = np.zeros(len(coefficients)), np.zeros(len(coefficients)), 0.0
            for batch in batches:
                if len(batch):
                    places = np.stack(batch["places"].to_numpy())
                    log_rate = coefficients[0] + coefficients[places].sum(axis=1)
                    fitted = batch["exposure"].to_numpy() * np.exp(np.minimum(log_rate, 60.0))
                    rest = fitted - batch["events"].to_numpy()
                    loss += float(fitted.sum() - (batch["events"].to_numpy() * log_rate).sum())
                    gradient += np.bincount(places.ravel(), np.repeat(rest, places.shape[1]), len(coefficients))
                    curvature += np.bincount(places.ravel(), np.repeat(fitted, places.shape[1]), len(coefficients))
                    gradient[0] += rest.sum()
                    curvature[0] += fitted.sum()
            used = np.flatnonzero(curvature)
            yield pd.DataFrame({"place": np.append(used, -1), "g": np.append(gradient[used], loss), "h": np.append(curvature[used], 0.0)})

        sums = placed.mapInPandas(partial, "place long, g double, h double").groupBy("place").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        gradient, curvature, loss = penalty * beta, penalty.copy(), float((penalty * beta * beta).sum() / 2)
        for place, g, h in sums:
            if place < 0:
                loss += g
            else:
                gradient[place] += g
                curvature[place] += h
        shared.unpersist()
        return loss, gradient, curvature

    beta = np.zeros(len(levels) + 1)
    beta[0] = np.log(totals["events"] / totals["exposure"])
    loss, gradient, curvature = evaluate(beta)
    scale, memory = 1.0 / np.maximum(curvature, 1e-12), []
    blocks = [np.array([i + 1 for i, (f, _) in enumerate(levels) if f == name]) for name in names]

    def scaled(vector):
        """Steps by the curvature at the start that leave every feature's sum as it is: at the optimum the sums are 0, as shifts between features only cost penalty."""
        out = vector * scale
        for block in blocks:
            out[block] -= scale[block] * (out[block].sum() / scale[block].sum())
        return out

    for _ in range(steps):
        if np.abs(gradient).max() <= tolerance * max(1.0, totals["events"]):
            break
        direction, kept = gradient.copy(), []
        for moved, turned in reversed(memory):
            share = (moved @ direction) / (turned @ moved)
            kept.append(share)
            direction -= share * turned
        if memory:
            moved, turned = memory[-1]
            direction = scaled(direction) * (moved @ turned) / (turned @ scaled(turned))
        else:
            direction = scaled(direction) / 2
        for (moved, turned), share in zip(memory, reversed(kept), strict=True):
            direction += moved * (share - (turned @ direction) / (turned @ moved))
        step, slope = 1.0, float(gradient @ direction)
        while True:
            trial = beta - step * direction
            next_loss, next_gradient, _ = evaluate(trial)
            if next_loss <= loss - 1e-4 * step * slope + 1e-12 * abs(loss) or step < 1e-8:
                break
            step /= 2
        moved, turned = trial - beta, next_gradient - gradient
        if moved @ turned > 1e-14:
            memory = [*memory[-19:], (moved, turned)]
        beta, loss, gradient = trial, next_loss, next_gradient
    else:
        raise ValueError(f"The hazard fit did not settle in {steps} steps")
    return table(beta[0], beta[1:])


def fitted_events(rows, coefficients, alpha=ALPHA):
    """Per level ``feature, value, events, fitted``: observed events and what the fit puts in their place, its penalty included. Equal at the optimum."""
    cells = hazard_cells(rows)
    names = [*FEATURES, "interval"]
    rated = cells.withColumn("log_rate", F.lit(0.0)).crossJoin(coefficients.filter("feature = ''").select(F.col("coefficient").alias("_0")))
    for name in names:
        own = coefficients.filter(F.col("feature") == name).select(F.col("value").alias("_v"), F.col("coefficient").alias("_c"))
        rated = rated.join(own, F.col(name).eqNullSafe(F.col("_v"))).withColumn("log_rate", F.col("log_rate") + F.col("_c")).drop("_v", "_c")
    rated = rated.withColumn("mu", F.col("exposure") * F.exp(F.col("log_rate") + F.col("_0")))
    pairs = F.explode(F.array(F.struct(F.lit("").alias("feature"), F.lit("").alias("value")), *[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names]))
    sums = rated.select(pairs.alias("p"), "events", "mu").groupBy("p.feature", "p.value").agg(F.sum("events").alias("events"), F.sum("mu").alias("mu")).alias("s")
    total = cells.agg((F.sum("exposure") * alpha).alias("penalty"))
    fit = coefficients.alias("c")
    fitted = F.col("mu") + F.when(F.col("s.feature") == "", 0.0).otherwise(F.col("penalty") * F.col("coefficient"))
    return sums.join(fit, F.expr("s.feature = c.feature AND s.value <=> c.value")).crossJoin(total).select("s.feature", "s.value", "events", fitted.alias("fitted"))


def hazard_rates(profiles, coefficients):
    """Seven bin rates per profile as ``rates``; unknown levels count zero, log rates are clamped to [-30, 10].

    Levels are joined by size: few are broadcast by the planner, many are not.
    """
    base = profiles.crossJoin(F.broadcast(coefficients.filter("feature = ''").select(F.col("coefficient").alias("log_rate"))))
    for name in FEATURES:
        levels = coefficients.filter(F.col("feature") == name).select(F.col("value").alias(name), F.col("coefficient").alias("_c"))
        base = base.join(levels, name, "left").withColumn(
            "log_rate", F.col("log_rate") + F.coalesce("_c", F.lit(0.0))).drop("_c")
    offsets = coefficients.filter("feature = 'interval'").agg(F.array(*[
        F.coalesce(F.max(F.when(F.col("value") == str(i), F.col("coefficient"))), F.lit(0.0)) for i in range(len(BINS) - 1)]).alias("_o"))
    rate = lambda o: F.exp(F.least(F.lit(10.0), F.greatest(F.lit(-30.0), F.col("log_rate") + o)))
    return base.crossJoin(F.broadcast(offsets)).withColumn("rates", F.transform("_o", rate)).drop("_o", "log_rate")


def cumulative_hazard(hours):
    total = F.lit(0.0)
    for i, (a, b) in enumerate(zip(BINS, BINS[1:])):
        total = total + F.get("rates", F.lit(i)) * F.greatest(F.lit(0.0), F.least(hours, F.lit(float(b))) - F.lit(float(a)))
    return total


def hazard_survival(hours):
    return F.exp(-cumulative_hazard(hours))


def hazard_median():
    """Time at which the cumulative hazard reaches ln 2, solved inside its bin; null beyond the last bin."""
    goal = F.log(F.lit(2.0))
    answer = F.lit(None).cast("double")
    for i, (a, b) in reversed(list(enumerate(zip(BINS, BINS[1:])))):
        before = cumulative_hazard(F.lit(float(a)))
        answer = F.when(cumulative_hazard(F.lit(float(b))) >= goal, a + (goal - before) / F.get("rates", F.lit(i))).otherwise(answer)
    return answer


def hazard_at_hours(profiles, hours=HORIZONS):
    cells = F.explode(F.array(*[F.struct(F.lit(h).alias("hours"), hazard_survival(F.lit(float(h))).alias("survival")) for h in hours]))
    return profiles.select(*FEATURES, cells.alias("c")).select(*FEATURES, "c.*")


def baseline_tables(rows, trained, curve, pooled, stratum="priority", hours=HORIZONS):
    """Stratum curves at fixed hours for the strata of ``rows``; strata absent from training use the pooled curve."""
    whole = curve_at_hours(pooled, [], hours).withColumnRenamed("survival", "_pooled")
    own = (trained.select(stratum).distinct().crossJoin(F.broadcast(whole.select("hours")))
           .join(curve_at_hours(curve, [stratum], hours), [stratum, "hours"], "left").na.fill(1.0, ["survival"]))
    return (rows.select(stratum).distinct().crossJoin(F.broadcast(whole)).join(own, [stratum, "hours"], "left")
            .select(stratum, "hours", F.coalesce("survival", "_pooled").alias("survival")))


def baseline_medians(rows, trained, curve, pooled, stratum="priority"):
    """Median of the stratum's own curve (null if it stays above one half); pooled median for untrained strata."""
    own = (trained.select(stratum).distinct().withColumn("_known", F.lit(True))
           .join(curve_median(curve, [stratum]), stratum, "left"))
    whole = curve_median(pooled).withColumnRenamed("median", "_pooled")
    return (rows.select(stratum).distinct().join(own, stratum, "left").crossJoin(F.broadcast(whole))
            .select(stratum, F.when(F.col("_known"), F.col("median")).otherwise(F.col("_pooled")).alias("median")))


def ipcw_brier(rows, survival, keys, censor_curve, by=(), hours=HORIZONS):
    """Brier score per horizon with inverse-probability-of-censoring weights, divided by all rows.

    ``survival`` is ``(keys…, hours, survival)``. Horizons whose censoring support is below 0.05 score null.
    Rows collapse to (keys, duration, event) counts first.
    """
    by, keys = list(by), list(keys)
    held = list(dict.fromkeys([*by, *keys]))
    counts = rows.groupBy(*held, "duration_us", "event").agg(F.count("*").alias("m")).withColumn("time_us", F.col("duration_us"))
    weighted = curve_asof(censor_curve, counts, left=True).withColumnRenamed("survival", "g_own")
    support = curve_at_hours(censor_curve, [], hours, left=True).withColumnRenamed("survival", "g_horizon")
    d, h = F.col("duration_us"), F.col("hours") * HOUR
    done, alive = F.col("event") & (d <= h), (d > h) | ((d == h) & ~F.col("event"))
    supported = F.col("g_horizon") >= SUPPORT_FLOOR
    s = F.col("survival")
    unstable = F.when(F.col("g_own") < SUPPORT_FLOOR, F.raise_error(F.lit("Too few rows are still observed to weigh this outcome")).cast("double"))
    loss = (F.when(~supported, F.lit(0.0)).when(done, s * s / F.coalesce(unstable, F.col("g_own")))
            .when(alive, (1 - s) * (1 - s) / F.col("g_horizon")).otherwise(F.lit(0.0)))
    # Without keys the survival table has one row per horizon.
    table = survival if keys else F.broadcast(survival)
    joined = weighted.crossJoin(F.broadcast(support)).join(table, [*keys, "hours"])
    return joined.groupBy(*by, "hours").agg(
        F.sum("m").alias("n"), F.when(F.max("g_horizon") >= SUPPORT_FLOOR, F.sum(F.col("m") * loss) / F.sum("m")).alias("ipcw_brier"),
        F.sum(F.when(supported & (done | alive), F.col("m")).otherwise(0)).alias("known_outcomes"))


def mean_brier(scores, by=()):
    return scores.groupBy(*by).agg(F.avg("ipcw_brier").alias("mean_ipcw_brier"))


def median_mae(rows, medians, keys, by=()):
    """Absolute error of the predicted median on observed resolutions (missing medians count as 168 h), with cohort counts."""
    predicted = F.coalesce(F.col("median"), F.lit(float(LIMIT_HOURS)))
    error = F.when(F.col("event"), F.abs(predicted - F.col("duration")))
    joined = rows.join(medians, list(keys)) if keys else rows.crossJoin(F.broadcast(medians))
    return joined.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("event").alias("resolved_within_168h"),
        F.count_if(~F.col("event") & (F.col("duration_us") < LIMIT_HOURS * HOUR)).alias("censored_before_168h"),
        F.avg(error).alias("observed_event_median_mae_hours"))


def select_candidate(scores):
    """Best Kaplan-Meier baseline, or the hazard model if it is at least 2 % better. ``scores``: (candidate, mean_ipcw_brier)."""
    value = lambda name: F.max(F.when(F.col("candidate") == name, F.col("mean_ipcw_brier")))
    wide = scores.agg(value("global_median").alias("g"), value("priority_median").alias("p"), value("piecewise_hazard").alias("h"))
    best = F.least("g", "p")
    return wide.select(F.when(F.col("g") <= F.col("p"), "global_median").otherwise("priority_median").alias("baseline"),
                       F.when(F.col("h") < 0.98 * best, "piecewise_hazard").when(F.col("g") <= F.col("p"), "global_median")
                       .otherwise("priority_median").alias("selected_model"))


def training_support(rows, names=FEATURES):
    """Distinct values per feature, with the training size and observed events repeated on each row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names]))
    totals = rows.agg(F.count("*").alias("training_n"), F.count_if("event").alias("observed_events"))
    return (rows.select(pairs.alias("p")).select("p.*").groupBy("feature", "value").agg(F.count("*").alias("rows"))
            .crossJoin(F.broadcast(totals)))


def category_drift(train, test, names=FIELDS):
    """Total variation between category shares of two cohorts, and the share of test rows with unseen values."""
    def shares(rows, side):
        pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("value")) for n in names]))
        counts = rows.select(pairs.alias("p")).groupBy("p.feature", "p.value").agg(F.count("*").alias(side))
        sizes = counts.groupBy("feature").agg(F.sum(side).alias(f"{side}_all"))
        return counts, sizes

    (a, a_all), (b, b_all) = shares(train, "train"), shares(test, "test")
    both = (a.join(b, ["feature", "value"], "full").na.fill(0, ["train", "test"]).join(F.broadcast(a_all), "feature")
            .join(F.broadcast(b_all), "feature"))
    return both.groupBy("feature").agg(
        (0.5 * F.sum(F.abs(F.col("train") / F.col("train_all") - F.col("test") / F.col("test_all")))).alias("total_variation"),
        F.sum(F.when(F.col("train") == 0, F.col("test") / F.col("test_all")).otherwise(0.0)).alias("unseen_test_fraction"))


def split_membership(splits):
    parts = [rows.select("incident_id", F.lit(name).alias("split")) for name, rows in splits.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def split_overlap(membership):
    """Incidents in more than one split; any row invalidates the study."""
    return (membership.groupBy("incident_id").agg(F.min("split").alias("one"), F.max("split").alias("other"))
            .filter(F.col("one") != F.col("other")))


def scenario_curves(scenarios, hours=LIMIT_HOURS):
    """Hourly survival of hazard profiles (``rates`` attached), from 0 to ``hours``."""
    return (scenarios.withColumn("hours", F.explode(F.sequence(F.lit(0), F.lit(hours))))
            .withColumn("survival", hazard_survival(F.col("hours").cast("double"))))
