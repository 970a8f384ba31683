"""Walk-forward demand forecasting for any number of series in one plan.

The *panel* holds, per (series, origin day), the last 28 and the next 14 values: one window stage, one exchange on
``series``. Every training row, evaluation row and forecast is an explode of panel rows over horizons, so nothing
else shuffles the data. Fits for all training ends come from Gram sums: each weekly origin is summed once
into the slot of the first end that may use it, slots are added up per end, and the small systems are
solved in Arrow batches.

All positions are day indexes; ``n`` is the common length of the series.
"""
import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.quantiles import rank_quantiles

HORIZON = 14
FIRST_ORIGIN = 55
MIN_TRAINING = 180
FOLDS = 3
FOLD_DAYS = 28
PENALTY = 8.0
INTERCEPT_PENALTY = 1e-8
MIN_IMPROVEMENT = 0.02
BAND_DAYS = 84
BAND_GROUPS = ((1, 7), (8, 14))
BAND_METHOD = "rolling-84-horizon-v1"
NOMINAL = 0.9
BASELINES = ("same_weekday", "four_week_mean")
CANDIDATES = BASELINES + ("seasonal_ridge",)
CHALLENGER = "weather_calendar_ridge"
CORE = ("bias", "lag1", "lag2", "lag3", "lag4", "mean7", "mean28", "sin_week", "cos_week", "sin_year", "cos_year", "lead")
EXTRA = ("holiday", "holiday_before", "holiday_after", "temperature_lag", "rain_lag")
SCALED = set(CORE[1:7])


def panel(series):
    """``series``: ``(series, day, day_idx, value)``. Adds ``past`` (28 values) and ``future`` (14) by day: a missing day is a null, never a shift.

    Means are over the days that are there.
    """
    order = Window.partitionBy("series").orderBy("day_idx")
    entries = F.collect_list(F.struct("day_idx", "value"))
    placed = lambda seen, low, high: F.expr(f"""if(size({seen}) = {high - low + 1}, {seen}.value,
        transform(sequence({low}, {high}), i -> get(filter({seen}, e -> e.day_idx = day_idx + i), 0).value))""")
    mean = lambda days: F.avg("value").over(order.rangeBetween(1 - days, 0))
    rows = series.select("series", "day", "day_idx", entries.over(order.rangeBetween(-27, 0)).alias("seen"),
                         entries.over(order.rangeBetween(1, HORIZON)).alias("ahead"), mean(7).alias("mean7"), mean(28).alias("mean28"))
    return rows.select("series", "day", "day_idx", placed("seen", -27, 0).alias("past"), placed("ahead", 1, HORIZON).alias("future"), "mean7", "mean28")


def seasonal_lag(k):
    """Value of the same weekday as the target, ``k`` weeks before the latest one seen at the origin."""
    offset = F.col("horizon") - 7 * F.ceil(F.col("horizon") / 7) - 7 * k
    return F.get("past", (27 + offset).cast("int")).cast("double")


def horizon_rows(origins, low=None, high=None):
    """One row per (origin, horizon) with target day, four lags and the actual value where it exists; none where one of its past values is missing."""
    low, high = (F.lit(1) if low is None else low), (F.lit(HORIZON) if high is None else high)
    rows = origins.select("*", F.explode(F.sequence(low, high)).alias("horizon"))
    return (rows.withColumn("target", F.date_add("day", F.col("horizon")))
            .withColumns({f"lag{k + 1}": seasonal_lag(k) for k in range(4)})
            .withColumn("actual", F.get("future", F.col("horizon") - 1)).drop("past", "future")
            .na.drop(subset=["lag1", "lag2", "lag3", "lag4"]))


def with_features(rows):
    """The twelve seasonal features, still in units of demand (scaling by the training mean is applied to sums)."""
    week = 2 * F.pi() * F.weekday("target") / 7
    year = 2 * F.pi() * F.dayofyear("target") / F.lit(365.25)
    return rows.withColumns({"bias": F.lit(1.0), "sin_week": F.sin(week), "cos_week": F.cos(week), "sin_year": F.sin(year),
                             "cos_year": F.cos(year), "lead": F.col("horizon") / F.lit(float(HORIZON))})


def with_challenger_features(rows, lagged, holidays):
    """Five more features: holiday on, before and after the target; covariate sums seen at the origin.

    ``lagged`` has one row per calendar day and ``holidays`` twelve per year, so both are broadcast.
    """
    rows = rows.join(F.broadcast(lagged), "day")
    for name, shift in (("holiday", 0), ("holiday_before", -1), ("holiday_after", 1)):
        flagged = holidays.select(F.date_add("day", -shift).alias("target"), F.lit(1.0).alias(name))
        rows = rows.join(F.broadcast(flagged), "target", "left")
    return rows.na.fill(0.0, ["holiday", "holiday_before", "holiday_after"])


def _pairs(names):
    return [(i, j) for i in range(len(names)) for j in range(i, len(names))]


def training_origins(origins, ends):
    """Weekly origins with the smallest training end that may use them (every target lies before that end)."""
    ordered = sorted(ends)
    slot = F.lit(None).cast("int")
    for end in reversed(ordered):
        slot = F.when(F.col("day_idx") < end - HORIZON, F.lit(end)).otherwise(slot)
    return (origins.filter((F.col("day_idx") >= FIRST_ORIGIN) & ((F.col("day_idx") - FIRST_ORIGIN) % 7 == 0)
                           & (F.col("day_idx") < ordered[-1] - HORIZON))
            .withColumn("slot", slot))


def training_rows(origins, end):
    """Feature rows and targets of one training end."""
    return with_features(horizon_rows(training_origins(origins, [end]))).drop("slot")


def training_scales(series, ends):
    """``max(1, mean of the first end values)`` for every training end."""
    mean = lambda end: F.greatest(F.lit(1.0), F.avg(F.when(F.col("day_idx") < end, F.col("value"))))
    pairs = F.array(*[F.struct(F.lit(end).alias("fit_end"), mean(end).alias("scale")) for end in sorted(ends)])
    return series.groupBy("series").agg(pairs.alias("p")).select("series", F.explode("p").alias("p")).select("series", "p.*")


def gram(rows, scales, ends, names=CORE):
    """Scaled normal equations per (series, fit_end): upper triangle ``xtx`` and ``xty`` as arrays, ``samples``."""
    ordered, pairs = sorted(ends), _pairs(names)
    sums = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]
    sums += [F.sum(F.col(name) * F.col("actual")).alias(f"t{i}") for i, name in enumerate(names)]
    slots = rows.groupBy("series", "slot").agg(*sums, F.count("*").alias("samples"))
    reach = F.explode(F.filter(F.array(*[F.lit(end) for end in ordered]), lambda end: end >= F.col("slot")))
    columns = [f"g{i}_{j}" for i, j in pairs] + [f"t{i}" for i in range(len(names))] + ["samples"]
    added = slots.withColumn("fit_end", reach).groupBy("series", "fit_end").agg(*[F.sum(c).alias(c) for c in columns])
    unit = {name: (1 / F.col("scale") if name in SCALED else F.lit(1.0)) for name in names}
    return added.join(scales, ["series", "fit_end"]).select(
        "series", "fit_end", "scale", "samples",
        F.array(*[F.col(f"g{i}_{j}") * unit[names[i]] * unit[names[j]] for i, j in pairs]).alias("xtx"),
        F.array(*[F.col(f"t{i}") * unit[name] / F.col("scale") for i, name in enumerate(names)]).alias("xty"))


def _solver(size, penalty, intercept_penalty):
    upper = np.array([(i, j) for i in range(size) for j in range(i, size)])
    ridge = np.full(size, penalty)
    ridge[0] = intercept_penalty

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        if len(xtx) == 0:
            return pd.Series([], dtype=object)
        sums = np.stack(xtx.to_numpy())
        matrix = np.zeros((len(xtx), size, size))
        matrix[:, upper[:, 0], upper[:, 1]] = sums
        matrix[:, upper[:, 1], upper[:, 0]] = sums
        matrix += np.diag(ridge)
        try:
            solution = np.linalg.solve(matrix, np.stack(xty.to_numpy())[:, :, None])[:, :, 0]
        except np.linalg.LinAlgError:
            raise ValueError("The normal equations have no unique solution")
        return pd.Series(list(solution))

    return solve


def ridge_fits(equations, names=CORE, penalty=PENALTY, intercept_penalty=INTERCEPT_PENALTY):
    """Coefficients per (series, fit_end): whole Arrow batches of small systems solved together."""
    solve = _solver(len(names), penalty, intercept_penalty)
    return equations.select("series", "fit_end", "scale", "samples", solve("xtx", "xty").alias("coefficients"))


def fit(series, origins, ends, prepare=with_features, names=CORE):
    """Ridge fits for all training ends at once. ``prepare`` adds the feature columns to horizon rows."""
    if min(ends) < MIN_TRAINING:
        raise ValueError("A fit needs 180 days of training")
    rows = prepare(horizon_rows(training_origins(origins, ends)))
    return ridge_fits(gram(rows, training_scales(series, ends), ends, names), names)


def ridge_prediction(names=CORE):
    """Expression over a feature row joined with its fit; negative demand is clamped, non-finite refused."""
    parts = [F.get("coefficients", F.lit(i)) * F.col(name) * (F.lit(1.0) if name in SCALED else F.col("scale"))
             for i, name in enumerate(names)]
    total = sum(parts[1:], parts[0])
    bad = F.isnan(total) | (F.abs(total) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("A prediction is not a finite number")).cast("double")).otherwise(F.greatest(F.lit(0.0), total))


def baseline_predictions(rows):
    return rows.withColumns({"same_weekday": F.col("lag1"),
                             "four_week_mean": (F.col("lag1") + F.col("lag2") + F.col("lag3") + F.col("lag4")) / 4})


def blocks(segment, fit_end, start, end, step=HORIZON, low=1, high=HORIZON):
    """Evaluation blocks ``[start, end)``: origins before each block, horizons limited to the range and to ``low..high``."""
    if fit_end > start:
        raise ValueError("Evaluated days lie inside the training range")
    return [(first - 1, segment, fit_end, low, min(high, end - first)) for first in range(start, end, step)
            if min(high, end - first) >= low]


def selection_ends(end):
    start = end - FOLDS * FOLD_DAYS
    if start < MIN_TRAINING:
        raise ValueError("Model choice needs 180 days of training before three whole windows")
    return list(range(start, end, FOLD_DAYS))


def selection_blocks(end, prefix="select"):
    return [b for i, first in enumerate(selection_ends(end))
            for b in blocks(f"{prefix}{i}", first, first, first + FOLD_DAYS)]


def evaluate(origins, fits, specs, prepare=with_features, names=CORE, candidate="seasonal_ridge"):
    """All evaluation rows of ``specs`` (tuples ``origin, segment, fit_end, low, high``; a table of fixed size)."""
    spark = origins.sparkSession
    table = spark.createDataFrame(specs, "day_idx int, segment string, fit_end int, low int, high int")
    rows = horizon_rows(origins.join(F.broadcast(table), "day_idx"), F.col("low"), F.col("high")).drop("low", "high")
    rows = baseline_predictions(prepare(rows))
    if fits is None:
        return rows
    return rows.join(fits.drop("samples"), ["series", "fit_end"]).withColumn(candidate, ridge_prediction(names))


def evaluation_columns(rows, candidates=CANDIDATES):
    return rows.select("series", "segment", "fit_end", F.col("day_idx").alias("origin_idx"), F.col("day").alias("origin"),
                       "horizon", "target", "actual", *candidates)


def long_candidates(rows, candidates=CANDIDATES):
    """One row per candidate: ``(…, candidate, predicted)``."""
    keep = [name for name in rows.columns if name not in candidates]
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("candidate"), F.col(name).alias("predicted")) for name in candidates]))
    return rows.select(*keep, pairs.alias("c")).select(*keep, "c.candidate", "c.predicted")


def error_metrics(rows, keys, predicted="predicted"):
    """MAE, WAPE (null where nothing was demanded) and row count per key."""
    error = F.sum(F.abs(F.col("actual") - F.col(predicted)))
    return rows.groupBy(*keys).agg((error / F.count("*")).alias("mae"),
                                   (100 * error / F.nullif(F.sum("actual"), F.lit(0))).alias("wape_pct"),
                                   F.count("*").alias("days"))


def improvement_gate(candidate, reference):
    """Columns of the gate between two arrays of fold errors: 2 % better in sum and at least two wins."""
    total = lambda errors: F.aggregate(errors, F.lit(0.0), lambda a, x: a + x)
    wins = F.aggregate(F.zip_with(candidate, reference, lambda c, r: (c < r).cast("int")), F.lit(0), lambda a, x: a + x)
    eligible = (total(reference) > 0) & (total(candidate) <= (1 - MIN_IMPROVEMENT) * total(reference)) & (wins >= 2)
    return eligible, wins, 100 * (1 - total(candidate) / F.nullif(total(reference), F.lit(0.0)))


def select_models(rows, keys=("series",)):
    """Two-stage selection per key from long fold rows ``(…, segment, candidate, actual, predicted)``.

    Start with the four-week mean; same weekday must pass the gate against it, the ridge against the winner.
    """
    folds = rows.groupBy(*keys, "candidate", "segment").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"))
    listed = folds.groupBy(*keys, "candidate").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("segment", "mae"))), lambda x: x["mae"]).alias("errors"))
    wide = listed.groupBy(*keys).agg(*[
        F.max(F.when(F.col("candidate") == name, F.col("errors"))).alias(name) for name in CANDIDATES])
    eligible, wins, gain = improvement_gate(F.col("same_weekday"), F.col("four_week_mean"))
    staged = wide.withColumns({"baseline_eligible": eligible, "baseline_wins": wins, "baseline_improvement_pct": gain})
    staged = staged.withColumn("baseline", F.when(F.col("baseline_eligible"), "same_weekday").otherwise("four_week_mean"))
    reference = F.when(F.col("baseline_eligible"), F.col("same_weekday")).otherwise(F.col("four_week_mean"))
    eligible, wins, gain = improvement_gate(F.col("seasonal_ridge"), reference)
    staged = staged.withColumns({"regression_eligible": eligible, "regression_wins": wins, "regression_improvement_pct": gain})
    return staged.withColumn("selected_model", F.when(F.col("regression_eligible"), "seasonal_ridge").otherwise(F.col("baseline"))
                             ).drop(*CANDIDATES)


def chosen_value(column="selected_model", candidates=CANDIDATES):
    value = F.lit(None).cast("double")
    for name in candidates:
        value = F.when(F.col(column) == name, F.col(name)).otherwise(value)
    return value


def calibration(rows, keys=("series",), level=NOMINAL):
    """Half width per key: rank quantile of absolute errors of ``(…, actual, predicted)`` rows."""
    errors = rows.withColumn("error", F.abs(F.col("actual") - F.col("predicted")))
    return rank_quantiles(errors, list(keys), "error", {"half_width": level})


def coverage(rows, widths, keys=("series",)):
    return (rows.join(widths, list(keys)).groupBy(*keys, "half_width")
            .agg((100 * F.avg((F.abs(F.col("actual") - F.col("predicted")) <= F.col("half_width")).cast("double"))).alias("coverage_pct"),
                 F.count("*").alias("days")))


NOMINAL_LEVELS = (50, 60, 70, 80, 90, 95)


def calibration_curve(calibrated, tested, keys=("series",)):
    """Half width and held-out coverage at six nominal levels, per key."""
    keys = list(keys)
    errors = calibrated.withColumn("error", F.abs(F.col("actual") - F.col("predicted")))
    names = {f"w{level}": level / 100 for level in NOMINAL_LEVELS}
    widths = rank_quantiles(errors, keys, "error", names).drop("residuals")
    pairs = F.explode(F.array(*[F.struct(F.lit(level).alias("nominal_pct"), F.col(f"w{level}").alias("half_width"))
                                for level in NOMINAL_LEVELS]))
    levels = widths.select(*keys, pairs.alias("p")).select(*keys, "p.*")
    hit = (F.abs(F.col("actual") - F.col("predicted")) <= F.col("half_width")).cast("double")
    return (tested.join(levels, keys).groupBy(*keys, "nominal_pct", "half_width")
            .agg((100 * F.avg(hit)).alias("actual_pct"), F.count("*").alias("test_dates")))


def band_group(horizon):
    return F.when(horizon <= BAND_GROUPS[0][1], F.lit(BAND_GROUPS[0][0])).otherwise(F.lit(BAND_GROUPS[1][0]))


def band_blocks(end, segment="band"):
    """84 residual days before ``end``, refitted every fortnight."""
    start = end - BAND_DAYS
    if start < MIN_TRAINING:
        raise ValueError("Calibration needs 180 days of training and 84 days of residuals")
    return [b for first in range(start, end, HORIZON) for b in blocks(segment, first, first, first + HORIZON)]


def band_widths(rows, keys=("series",)):
    """Half width per key and horizon group ``(horizon_start, horizon_end, residuals, half_width)``."""
    grouped = rows.withColumn("horizon_start", band_group(F.col("horizon")))
    widths = calibration(grouped, [*keys, "horizon_start"])
    return widths.withColumn("horizon_end", F.when(F.col("horizon_start") == BAND_GROUPS[0][0], BAND_GROUPS[0][1])
                             .otherwise(BAND_GROUPS[1][1]))


def band_bounds(rows, widths, keys=("series",), predicted="predicted"):
    """Range lookup of the horizon group: ``lower`` clamped at zero, ``upper``. Two rows per key on the other side."""
    matched = F.col("horizon").between(F.col("horizon_start"), F.col("horizon_end"))
    return (rows.join(widths.select(*keys, "horizon_start", "horizon_end", "half_width"), list(keys)).filter(matched)
            .withColumn("lower", F.greatest(F.lit(0.0), F.col(predicted) - F.col("half_width")))
            .withColumn("upper", F.col(predicted) + F.col("half_width"))
            .drop("horizon_start", "horizon_end", "half_width"))


def interval_score(rows, keys, actual="actual", lower="lower", upper="upper", date="target"):
    """Predictions, distinct dates, coverage, mean width and mean interval score (miss distance counts 20-fold)."""
    a, lo, hi = F.col(actual), F.col(lower), F.col(upper)
    # Two steps, so that distinct dates need no second copy of the rows.
    width = hi - lo
    score = width + 20 * F.greatest(lo - a, F.lit(0.0)) + 20 * F.greatest(a - hi, F.lit(0.0))
    per_date = rows.groupBy(*keys, F.col(date).alias("_d")).agg(
        F.count("*").alias("n"), F.count_if(a.between(lo, hi)).alias("hit"), F.sum(width).alias("w"), F.sum(score).alias("s"))
    return per_date.groupBy(*keys).agg(
        F.sum("n").alias("predictions"), F.count("*").alias("distinct_target_dates"),
        (100 * F.sum("hit") / F.sum("n")).alias("coverage_pct"), (F.sum("w") / F.sum("n")).alias("mean_width"),
        (F.sum("s") / F.sum("n")).alias("mean_interval_score"))


def replay_blocks(n, start, fit_end):
    """Daily origins from the day before ``start``; two days of publication lag leave horizons 3 to 14."""
    return [(origin, "replay", fit_end, 3, min(HORIZON, n - origin - 1)) for origin in range(start - 1, n - 3)]


LEAD_BANDS = ((1, 3), (4, 7), (8, 14))


def lead_band(lead):
    label = F.lit(None).cast("string")
    for low, high in reversed(LEAD_BANDS):
        label = F.when(lead.between(low, high), F.lit(f"{low}–{high}")).otherwise(label)
    return label


def error_heatmap(replay, keys=("series",)):
    """Error by target weekday and lead band on the full 7 x 3 grid; empty cells stay with a null WAPE."""
    spark = replay.sparkSession
    grid = spark.createDataFrame([(d, f"{lo}–{hi}") for d in range(7) for lo, hi in LEAD_BANDS], "weekday int, lead string")
    cells = (replay.withColumn("weekday", F.weekday("target")).withColumn("lead", lead_band(F.col("horizon") - 2))
             .groupBy(*keys, "weekday", "lead", "target").agg(
                 F.count("*").alias("n"), F.sum(F.abs(F.col("actual") - F.col("predicted"))).alias("e"), F.sum("actual").alias("a"))
             .groupBy(*keys, "weekday", "lead").agg(
                 F.sum("n").alias("predictions"), F.count("*").alias("dates"),
                 (100 * F.sum("e") / F.nullif(F.sum("a"), F.lit(0))).alias("wape_pct")))
    return (replay.select(*keys).distinct().crossJoin(F.broadcast(grid)).join(cells, [*keys, "weekday", "lead"], "left")
            .na.fill(0, ["predictions", "dates"]))


def weekly_errors(replay, keys=("series",)):
    week = F.date_add("target", -F.weekday("target"))
    return error_metrics(replay.withColumn("week", week), [*keys, "week"])


def worst_cell(heatmap, keys=("series",)):
    return (heatmap.filter(F.col("wape_pct").isNotNull()).groupBy(*keys)
            .agg(F.max_by(F.struct("weekday", "lead", "wape_pct", "dates"),
                          F.struct("wape_pct", -F.col("weekday"), F.col("lead"))).alias("w")).select(*keys, "w.*"))


def evaluation_windows(n):
    """Index ranges (inclusive) of the evaluation design of a series of length ``n``."""
    if n < 365:
        raise ValueError("The report windows need a whole year of days")
    return (("selection", n - 168, n - 85), ("calibration", n - 84, n - 43), ("test", n - 42, n - 1), ("history", n - 90, n - 1))


def final_blocks(n, segment="final"):
    return [(n - 1, segment, n, 1, HORIZON)]


def forecast_table(predictions, widths, shadow):
    """Published rows: rounded forecast and integer band, all candidates, and the shadow band as maps.

    ``predictions`` has ``(series, selected_model, target, horizon, candidates…, predicted)``.
    """
    candidates = F.create_map(*[part for name in CANDIDATES for part in (F.lit(name), F.bround(F.col(name), 2))])
    width = F.col("half_width")
    base = predictions.join(widths.select("series", "half_width"), "series").select(
        "series", "selected_model", "target", "horizon", "predicted", F.bround("predicted", 0).cast("bigint").alias("forecast"),
        F.greatest(F.lit(0), F.floor(F.col("predicted") - width)).alias("lower"),
        F.ceil(F.col("predicted") + width).alias("upper"), candidates.alias("candidates"))
    bands = band_bounds(base.select("series", "target", "horizon", "predicted"), shadow).select(
        "series", "target", F.create_map(F.lit(BAND_METHOD), F.struct(
            F.greatest(F.lit(0), F.floor("lower")).alias("lower"), F.ceil("upper").alias("upper"))).alias("shadow_intervals"))
    return base.join(bands, ["series", "target"])


def capacity_excess(forecast, capacity):
    return forecast.select("series", "target", "forecast", "lower", "upper", F.lit(capacity).alias("daily_capacity"),
                           F.greatest(F.lit(0), F.col("forecast") - capacity).alias("above_capacity"))


def capacity_curve(forecast, steps=60):
    """Demand above each of ``steps + 1`` capacities from zero to the highest upper band, per series."""
    top = forecast.groupBy("series").agg(F.greatest(F.lit(1), F.max("upper")).alias("top"))
    levels = top.select("series", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"), "top").withColumn(
        "capacity", F.col("step") * F.col("top") / F.lit(float(steps)))
    over = lambda name: F.sum(F.greatest(F.lit(0.0), F.col(name) - F.col("capacity")))
    return forecast.join(levels, "series").groupBy("series", "step", "capacity").agg(
        over("forecast").alias("forecast_excess"), over("upper").alias("upper_excess"))
