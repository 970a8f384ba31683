"""Queries over daily demand: sources, features, fits, selection, bands and diagnostics."""
from datetime import timedelta

from pyspark.sql import functions as F

from tideline.functions.calendar import holidays
from tideline.operators import demand as dm
from tideline.operators import forecast as fc
from tideline.plans import demand_study as study
from tideline.plans.audit import AUDIT_SQL, audit
from tideline.plans.demand_sql import (CHALLENGER_SQL, CHOSEN_SQL, CORE_SQL, COVARIATE_SQL, DEMAND_SQL, HOLIDAY_SQL,
                                       LONG_SQL, N, OBS_SQL, choice_sql, fits_sql, gram_sql, rank_sql, rows_sql)
from tideline.plans.registry import query, rounded
from tideline.session import materialize, read_table

TIME = "l_shipdate"


def lines(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem")


def window(spark, sf_dir):
    latest = dm.latest_day(lines(spark, sf_dir), TIME)
    return dm.demand_window(latest, latest + timedelta(days=1))


def counted(spark, sf_dir):
    start, end = window(spark, sf_dir)
    return dm.daily_demand(lines(spark, sf_dir), TIME, "l_linestatus", start, end + timedelta(days=1)), start


def dense(spark, sf_dir):
    """Dense series, stored once: from here on the data is one row per series and calendar day."""
    rows, start = counted(spark, sf_dir)
    return materialize(dm.demand_series(rows, start), "demand")


def covariates(spark, sf_dir):
    """Daily readings next to the demand series: one row per calendar day."""
    return lines(spark, sf_dir).groupBy(F.to_date(TIME).alias("day")).agg(
        F.avg("l_quantity").alias("temperature"), F.avg("l_discount").alias("rain"))


def run(spark, sf_dir):
    return study.Study(dense(spark, sf_dir), N)


# ---- sources ------------------------------------------------------------------------------------------------

@query("q_daily_demand", "WITH " + DEMAND_SQL + " SELECT series, day, value FROM counted")
def daily_demand(spark, sf_dir):
    return counted(spark, sf_dir)[0].select("series", "day", "value")


@query("q_demand_window", """SELECT CAST(max(l_shipdate) AS DATE) AS latest_day, CAST(max(l_shipdate) AS DATE) - 730 AS start_day,
  CAST(max(l_shipdate) AS DATE) - 1 AS end_day FROM lineitem""")
def demand_window(spark, sf_dir):
    start, end = window(spark, sf_dir)
    return lines(spark, sf_dir).agg(F.to_date(F.max(TIME)).alias("latest_day")).withColumns(
        {"start_day": F.lit(start), "end_day": F.lit(end)})


@query("q_demand_series", "WITH " + DEMAND_SQL + " SELECT series, day, day_idx, value FROM demand")
def demand_series(spark, sf_dir):
    rows, start = counted(spark, sf_dir)
    return dm.demand_series(rows, start)


@query("q_demand_refresh", "WITH " + DEMAND_SQL + """,
older AS (SELECT l_linestatus AS series, CAST(l_shipdate AS DATE) AS day, count(*) AS value FROM lineitem, bounds
  WHERE l_shipdate >= first_day AND l_shipdate < last_day + 1 AND l_returnflag <> 'R' GROUP BY 1, 2),
cover AS (SELECT count(DISTINCT day) = any_value(last_day - 59 - first_day) + 1 AS usable FROM older, bounds WHERE day <= last_day - 59)
SELECT day, CASE WHEN series = 'F' THEN 'F' ELSE 'Unknown' END AS series, value FROM older, bounds, cover WHERE day < last_day - 59 AND usable
UNION ALL SELECT day, CASE WHEN series = 'F' THEN 'F' ELSE 'Unknown' END, value FROM counted, bounds, cover WHERE day >= last_day - 59 OR NOT usable""")
def demand_refresh(spark, sf_dir):
    """An older extract (without one return flag) is refreshed for 60 days; ``O`` plays the unnamed area."""
    start, end = window(spark, sf_dir)
    name = F.when(F.col("l_linestatus") == "F", "F").otherwise("Unknown")
    source = lines(spark, sf_dir).withColumn("area", name)
    old = dm.daily_demand(source.filter("l_returnflag <> 'R'"), TIME, "area", start, end + timedelta(days=1))
    cached = dm.demand_series(old, start, ["F"]).select("day", "series", "value")
    fresh = dm.daily_demand(source, TIME, "area", start, end + timedelta(days=1))
    today = end + timedelta(days=2)
    return dm.refresh_demand(cached, fresh, ["F"], start, end, today, today - timedelta(days=10))[0]


FLAGGED_SQL = """flagged AS (SELECT DISTINCT l_returnflag || '-' || CAST(l_linenumber AS VARCHAR) AS series, CAST(l_shipdate AS DATE) AS day FROM lineitem),
span AS (SELECT min(day) AS a, max(day) AS b FROM flagged)"""


def flagged(spark, sf_dir):
    """Series by return flag and line number: many have days without rows."""
    name = F.concat_ws("-", "l_returnflag", F.col("l_linenumber").cast("string"))
    return materialize(lines(spark, sf_dir).select(name.alias("series"), F.to_date(TIME).alias("day")).distinct(), "flagged")


@query("q_series_islands", "WITH " + FLAGGED_SQL + """, marked AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY series ORDER BY day) AS INTEGER) AS island FROM flagged)
SELECT series, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM marked GROUP BY series, island""")
def series_islands(spark, sf_dir):
    return dm.coverage_islands(flagged(spark, sf_dir))


@query("q_refused_series", "WITH " + FLAGGED_SQL + """, marked AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY series ORDER BY day) AS INTEGER) AS island FROM flagged)
SELECT series, count(DISTINCT island) AS islands, CAST(any_value(b - a) + 1 - count(*) AS BIGINT) AS missing_days FROM marked, span GROUP BY series HAVING count(*) < any_value(b - a) + 1""")
def refused_series(spark, sf_dir):
    """Series that a fit over the whole range refuses, by name."""
    rows = flagged(spark, sf_dir)
    span = rows.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    return dm.refused_series(rows, span["a"], span["b"])


@query("q_covariate_coverage", "WITH " + DEMAND_SQL + ", " + COVARIATE_SQL + """
SELECT day, round(CASE WHEN day >= last_day - 35 THEN temperature + 1 ELSE temperature END, 6) AS temperature, round(rain, 6) AS rain,
  false AS missing FROM covariates, bounds WHERE day BETWEEN first_day - 12 AND last_day
UNION ALL SELECT last_day + CAST(i AS INTEGER), NULL, NULL, true FROM bounds, (SELECT unnest(range(2, 5)) AS i)""")
def covariate_coverage(spark, sf_dir):
    """Cached readings, the last month read again with other values, and the days beyond the source reported as gaps."""
    start, end = window(spark, sf_dir)
    cached = covariates(spark, sf_dir).filter(F.col("day") <= F.lit(end))
    fresh = cached.filter(F.col("day") >= F.lit(end - timedelta(days=35))).withColumn("temperature", F.col("temperature") + 1)
    merged = dm.merge_covariates(cached, fresh, start - timedelta(days=12), end)
    gaps = dm.covariate_gaps(covariates(spark, sf_dir), start - timedelta(days=12), end + timedelta(days=4))
    return rounded(merged.withColumn("missing", F.lit(False)).unionByName(
        gaps.withColumn("missing", F.lit(True)), allowMissingColumns=True).select("day", "temperature", "rain", "missing"))


@query("q_demand_violations", "WITH " + DEMAND_SQL + """,
flags AS (SELECT l_returnflag AS series, CAST(l_shipdate AS DATE) AS day, count(*) AS value FROM lineitem GROUP BY 1, 2),
span AS (SELECT CAST(min(l_shipdate) AS DATE) AS a, CAST(max(l_shipdate) AS DATE) AS b FROM lineitem),
spoiled AS (SELECT series, day, CASE WHEN dayofyear(day) % 50 = 3 THEN '0' || CAST(value AS VARCHAR) WHEN dayofyear(day) % 50 = 4 THEN '0'
    ELSE CAST(value AS VARCHAR) END AS requests FROM flags)
SELECT day, series, 'invalid' AS problem FROM spoiled WHERE requests LIKE '0%'
UNION ALL SELECT day, series, 'duplicate' FROM flags WHERE dayofyear(day) = 100
UNION ALL SELECT day, series, 'missing' FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
  (VALUES ('A'), ('N'), ('R')) t(series) WHERE (day, series) NOT IN (SELECT (day, series) FROM flags)""")
def demand_violations(spark, sf_dir):
    source = lines(spark, sf_dir)
    low, high = source.agg(F.to_date(F.min(TIME)), F.to_date(F.max(TIME))).first()
    flags = source.groupBy(F.to_date(TIME).alias("day"), F.col("l_returnflag").alias("series")).agg(F.count("*").alias("value"))
    text = F.col("value").cast("string")
    spoiled = flags.withColumn("requests", F.when(F.dayofyear("day") % 50 == 3, F.concat(F.lit("0"), text))
                               .when(F.dayofyear("day") % 50 == 4, F.lit("0")).otherwise(text)).drop("value")
    twice = spoiled.unionByName(spoiled.filter(F.dayofyear("day") == 100))
    return dm.demand_violations(twice, ["A", "N", "R"], low, high)


@query("q_demand_quality", "WITH " + DEMAND_SQL + """ SELECT count(DISTINCT day) AS days, count(*) AS rows,
  CAST(sum(CASE WHEN series = 'F' THEN 0 ELSE value END) AS BIGINT) AS unknown_requests FROM counted""")
def demand_quality(spark, sf_dir):
    """Only ``F`` counts as a named area here; the rest are requests outside the named ones."""
    return dm.demand_quality(counted(spark, sf_dir)[0], ["F"])


@query("q_source_revisions", "WITH " + DEMAND_SQL + """,
older AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS value FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT count(*) FILTER (WHERE d.value <> o.value) AS changed_dates, CAST(sum(abs(d.value - o.value)) AS BIGINT) AS absolute_revised,
  CAST(sum(d.value - o.value) AS BIGINT) AS net_revised FROM demand d JOIN older o ON o.day = d.day WHERE d.series = 'TOTAL'""")
def source_revisions(spark, sf_dir):
    old = lines(spark, sf_dir).filter("l_returnflag <> 'R'").groupBy(F.to_date(TIME).alias("day")).agg(F.count("*").alias("value"))
    now = dense(spark, sf_dir).filter(F.col("series") == dm.TOTAL).select("day", "value")
    return dm.source_revisions(old, now)


@query("q_demand_shift", "WITH " + DEMAND_SQL + f""", halves AS (SELECT series, avg(value) FILTER (WHERE day_idx >= {N - 28}) AS a,
  avg(value) FILTER (WHERE day_idx >= {N - 56} AND day_idx < {N - 28}) AS b FROM demand GROUP BY series)
SELECT series, round((a / b - 1) * 100, 6) AS demand_shift_pct, abs((a / b - 1) * 100) > 30 AS demand_shift_warning FROM halves""")
def demand_shift(spark, sf_dir):
    return rounded(dm.demand_shift(dense(spark, sf_dir), N))


@query("q_history_profile", "WITH " + AUDIT_SQL + """, firsts AS (SELECT incident_id, min(updated_at) AS f FROM audit GROUP BY 1)
SELECT (SELECT count(*) FROM audit) AS event_rows, (SELECT min(updated_at) FROM audit) AS update_start,
  (SELECT max(updated_at) FROM audit) AS update_end, count(*) AS incidents, CAST(min(f) AS DATE) AS arrival_start,
  CAST(max(f) AS DATE) AS arrival_end, count(DISTINCT CAST(f AS DATE)) AS arrival_days_with_incidents,
  round(quantile_cont(date_diff('microsecond', TIMESTAMP '1970-01-01', f) / 3.6e9, 0.95), 6) AS arrivals_95_percent_epoch_hour,
  (SELECT CAST(date_diff('day', CAST(min(updated_at) AS DATE), CAST(max(updated_at) AS DATE)) + 1 AS INTEGER) FROM audit) AS update_calendar_days,
  CAST(date_diff('day', CAST(min(f) AS DATE), CAST(max(f) AS DATE)) + 1 AS INTEGER) AS arrival_calendar_days,
  round((date_diff('day', CAST(min(f) AS DATE), CAST(max(f) AS DATE)) + 1) / 7.0, 6) AS arrival_weeks,
  date_diff('day', CAST(min(f) AS DATE), CAST(max(f) AS DATE)) + 1 - count(DISTINCT CAST(f AS DATE)) AS zero_arrival_days FROM firsts""")
def history_profile(spark, sf_dir):
    return rounded(dm.history_profile(audit(spark, sf_dir), "incident_id", "updated_at", "updated_at"))


@query("q_arrivals_by_month", """SELECT strftime(o, '%Y-%m') AS month, count(*) AS incidents
FROM (SELECT o_custkey, min(o_orderdate) AS o FROM orders GROUP BY 1) GROUP BY 1""")
def arrivals_by_month(spark, sf_dir):
    return dm.arrivals_by_month(read_table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@query("q_history_baselines", """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS v FROM orders GROUP BY 1),
s AS (SELECT min(day) AS a, max(day) AS b FROM c),
dense AS (SELECT d.day, coalesce(v, 0) AS v, date_diff('day', a, d.day) AS i, date_diff('day', a, b) + 1 AS n
  FROM s, (SELECT CAST(unnest(generate_series((SELECT min(day) FROM c), (SELECT max(day) FROM c), INTERVAL 1 DAY)) AS DATE) AS day) d
  LEFT JOIN c ON c.day = d.day),
t AS (SELECT *, lag(v, 7) OVER (ORDER BY day) AS w, (lag(v, 7) OVER (ORDER BY day) + lag(v, 14) OVER (ORDER BY day)
    + lag(v, 21) OVER (ORDER BY day) + lag(v, 28) OVER (ORDER BY day)) / 4.0 AS m4,
    avg(v) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS m7 FROM dense)
SELECT count(*) AS evaluation_days, min(day) AS evaluation_start, round(avg(v), 6) AS mean_daily,
  round(avg(abs(v - w)), 6) AS same_weekday_last_week, round(avg(abs(v - m4)), 6) AS previous_four_same_weekdays,
  round(avg(abs(v - m7)), 6) AS last_7_days_mean, round(avg(abs(v)), 6) AS zero_control
FROM t WHERE i >= greatest(28, floor(n * CAST(0.7 AS DOUBLE)))""")
def history_baselines(spark, sf_dir):
    arrivals = read_table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("value"))
    return rounded(dm.history_baselines(arrivals))


# ---- calendar and features ----------------------------------------------------------------------------------

@query("q_holidays", "WITH " + HOLIDAY_SQL + """ SELECT DISTINCT day FROM holidays, (SELECT year(min(o_orderdate)) AS a, year(max(o_orderdate)) AS b FROM orders)
WHERE EXISTS (SELECT 1 FROM years WHERE y BETWEEN a AND b AND (year(day) = y OR (year(day) = y - 1 AND month(day) = 12 AND day(day) = 31 AND isodow(day) = 5)))""")
def holiday_table(spark, sf_dir):
    """Holidays of every year that has orders."""
    years = read_table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return holidays(years)


@query("q_calendar_features", "WITH " + HOLIDAY_SQL + """, d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, CAST(isodow(day) - 1 AS INTEGER) AS weekday, CAST(dayofyear(day) AS INTEGER) AS day_of_year,
  day - CAST(isodow(day) - 1 AS INTEGER) AS week_start, day IN (SELECT day FROM holidays) AS holiday,
  day - 1 IN (SELECT day FROM holidays) AS holiday_before, day + 1 IN (SELECT day FROM holidays) AS holiday_after FROM d""")
def calendar_features(spark, sf_dir):
    days = read_table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    years = days.select(F.explode(F.array(F.year("day") - 1, F.year("day"), F.year("day") + 1)).alias("year")).distinct()
    calendar = holidays(years)
    for name, shift in (("holiday", 0), ("holiday_before", -1), ("holiday_after", 1)):
        flagged = calendar.select(F.date_add("day", -shift).alias("day"), F.lit(True).alias(name))
        days = days.join(F.broadcast(flagged), "day", "left")
    return days.na.fill(False).select("day", F.weekday("day").alias("weekday"), F.dayofyear("day").alias("day_of_year"),
                                      F.date_add("day", -F.weekday("day")).alias("week_start"), "holiday", "holiday_before", "holiday_after")


def complete_origins(spark, sf_dir):
    return fc.panel(dense(spark, sf_dir)).filter(F.col("day_idx") >= 27)


@query("q_seasonal_lags", "WITH " + OBS_SQL + " SELECT series, day_idx, horizon, target, lag1, lag2, lag3, lag4 FROM obs")
def seasonal_lags(spark, sf_dir):
    return fc.horizon_rows(complete_origins(spark, sf_dir)).select("series", "day_idx", "horizon", "target", "lag1", "lag2", "lag3", "lag4")


FEATURES = ("lag1", "lag2", "lag3", "lag4", "mean7", "mean28", "sin_week", "cos_week", "sin_year", "cos_year", "lead")


@query("q_forecast_features", "WITH " + CORE_SQL + " SELECT series, day_idx, horizon, "
       + ", ".join(f"round({name}, 6) AS {name}" for name in FEATURES) + " FROM feat")
def forecast_features(spark, sf_dir):
    return rounded(fc.with_features(fc.horizon_rows(complete_origins(spark, sf_dir))).select("series", "day_idx", "horizon", *FEATURES))


@query("q_challenger_features", "WITH " + CHALLENGER_SQL + """ SELECT series, day_idx, horizon, target, holiday, holiday_before, holiday_after,
  round(temperature_lag, 6) AS temperature_lag, round(rain_lag, 6) AS rain_lag FROM feat""")
def challenger_features(spark, sf_dir):
    series = dense(spark, sf_dir)
    prepare = study.challenger_features(series, covariates(spark, sf_dir))
    rows = prepare(fc.horizon_rows(fc.panel(series).filter(F.col("day_idx") >= 27)))
    return rounded(rows.select("series", "day_idx", "horizon", "target", *fc.EXTRA))


@query("q_training_rows", "WITH " + CORE_SQL + f""" SELECT series, day_idx, horizon, actual, """
       + ", ".join(f"round({name}, 6) AS {name}" for name in FEATURES)
       + f" FROM feat WHERE day_idx >= 55 AND (day_idx - 55) % 7 = 0 AND day_idx < {N - 84 - 14}")
def training_rows(spark, sf_dir):
    rows = fc.training_rows(fc.panel(dense(spark, sf_dir)), N - 84)
    return rounded(rows.select("series", "day_idx", "horizon", "actual", *FEATURES))


GRAM_ENDS = [N - 168, N - 84, N]


@query("q_ridge_gram", "WITH " + gram_sql(GRAM_ENDS) + """ SELECT series, CAST(fit_end AS INTEGER) AS fit_end, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
  samples, round(v, 5) AS v FROM sums WHERE j >= i""")
def ridge_gram(spark, sf_dir):
    series = dense(spark, sf_dir)
    rows = fc.with_features(fc.horizon_rows(fc.training_origins(fc.panel(series), GRAM_ENDS)))
    sums = fc.gram(rows, fc.training_scales(series, GRAM_ENDS), GRAM_ENDS)
    pairs = [(i, j) for i in range(1, 13) for j in range(i, 13)]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.get("xtx", F.lit(k)).alias("v")) for k, (i, j) in enumerate(pairs)]
    cells += [F.struct(F.lit(i).alias("i"), F.lit(13).alias("j"), F.get("xty", F.lit(i - 1)).alias("v")) for i in range(1, 13)]
    return rounded(sums.select("series", "fit_end", "samples", F.explode(F.array(*cells)).alias("c")).select(
        "series", "fit_end", "c.i", "c.j", "samples", "c.v"), 5)


@query("q_ridge_fit", "WITH RECURSIVE " + fits_sql(GRAM_ENDS) + """ SELECT series, CAST(fit_end AS INTEGER) AS fit_end, round(scale, 6) AS scale,
  CAST(position AS INTEGER) AS position, round(coefficients[position], 6) AS coefficient FROM fits, (SELECT unnest(range(1, 13)) AS position)""")
def ridge_fit(spark, sf_dir):
    series = dense(spark, sf_dir)
    fits = fc.fit(series, fc.panel(series), GRAM_ENDS)
    return rounded(fits.select("series", "fit_end", "scale", F.posexplode("coefficients").alias("p", "coefficient")).select(
        "series", "fit_end", "scale", (F.col("p") + 1).alias("position"), "coefficient"))


# ---- evaluation ---------------------------------------------------------------------------------------------

TEST = fc.blocks("test", N - 84, N - 42, N)
SELECTION = fc.selection_blocks(N - 84)
ROW_COLUMNS = "series, segment, CAST(origin_idx AS INTEGER) AS origin_idx, origin, horizon, target, actual"


def only(candidate):
    return rows_sql(TEST) + f" SELECT {ROW_COLUMNS}, round({candidate}, 6) AS predicted FROM evaluated"


def test_rows(spark, sf_dir, candidate):
    series = dense(spark, sf_dir)
    rows = fc.evaluate(fc.panel(series), None, TEST).select("series", "segment", F.col("day_idx").alias("origin_idx"),
                                                            F.col("day").alias("origin"), "horizon", "target", "actual",
                                                            F.col(candidate).alias("predicted"))
    return rounded(rows)


@query("q_same_weekday", only("same_weekday"))
def same_weekday(spark, sf_dir):
    return test_rows(spark, sf_dir, "same_weekday")


@query("q_four_week_mean", only("four_week_mean"))
def four_week_mean(spark, sf_dir):
    return test_rows(spark, sf_dir, "four_week_mean")


@query("q_ridge_predict", only("seasonal_ridge"))
def ridge_predict(spark, sf_dir):
    rows = study.predictions(dense(spark, sf_dir), TEST)
    return rounded(rows.select("series", "segment", "origin_idx", "origin", "horizon", "target", "actual",
                               F.col("seasonal_ridge").alias("predicted")))


CHALLENGE = TEST + fc.final_blocks(N)


@query("q_challenger_predict", rows_sql(CHALLENGE, extra=True) + f"""
SELECT {ROW_COLUMNS}, round(weather_calendar_ridge, 6) AS predicted FROM evaluated""")
def challenger_predict(spark, sf_dir):
    rows = study.challenger_predictions(dense(spark, sf_dir), materialize(covariates(spark, sf_dir), "covariates"), CHALLENGE)
    return rounded(rows.select("series", "segment", "origin_idx", "origin", "horizon", "target", "actual",
                               F.col(fc.CHALLENGER).alias("predicted")))


@query("q_walk_forward", rows_sql(SELECTION) + f"""
SELECT {ROW_COLUMNS}, same_weekday, four_week_mean, round(seasonal_ridge, 6) AS seasonal_ridge FROM evaluated""")
def walk_forward(spark, sf_dir):
    return rounded(study.predictions(dense(spark, sf_dir), SELECTION).drop("fit_end"))


@query("q_forecast_metrics", rows_sql(SELECTION + TEST) + LONG_SQL + """
SELECT series, segment, candidate, round(avg(abs(actual - predicted)), 6) AS mae,
  round(100 * sum(abs(actual - predicted)) / nullif(sum(actual), 0), 6) AS wape_pct, count(*) AS days FROM candidates GROUP BY ALL""")
def forecast_metrics(spark, sf_dir):
    rows = study.predictions(dense(spark, sf_dir), SELECTION + TEST)
    return rounded(fc.error_metrics(fc.long_candidates(rows), ["series", "segment", "candidate"]))


@query("q_model_selection", rows_sql(SELECTION) + choice_sql() + """
SELECT series, baseline_eligible, baseline_wins, round(baseline_improvement_pct, 6) AS baseline_improvement_pct, baseline,
  regression_eligible, regression_wins, round(regression_improvement_pct, 6) AS regression_improvement_pct, selected_model FROM choice""")
def model_selection(spark, sf_dir):
    return rounded(study.selected(study.predictions(dense(spark, sf_dir), SELECTION)))


GATE_SQL = DEMAND_SQL + """, folds AS (SELECT series, CAST(floor(day_idx * 3.0 / 730) AS INTEGER) AS fold, avg(abs(value - 40)) AS c, avg(abs(value - 39)) AS r
  FROM demand GROUP BY 1, 2)"""


@query("q_selection_gate", "WITH " + GATE_SQL + """
SELECT series, sum(r) > 0 AND sum(c) <= 0.98 * sum(r) AND count(*) FILTER (WHERE c < r) >= 2 AS eligible,
  CAST(count(*) FILTER (WHERE c < r) AS INTEGER) AS wins, round(100 * (1 - sum(c) / nullif(sum(r), 0)), 6) AS improvement_pct
FROM folds GROUP BY series""")
def selection_gate(spark, sf_dir):
    """The gate alone, on two constant predictors over three thirds of the history."""
    thirds = dense(spark, sf_dir).withColumn("fold", F.floor(F.col("day_idx") * 3 / N).cast("int"))
    error = lambda value: F.avg(F.abs(F.col("value") - value))
    folds = thirds.groupBy("series", "fold").agg(error(40).alias("c"), error(39).alias("r"))
    wide = folds.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("fold", "c", "r"))).alias("f"))
    eligible, wins, gain = fc.improvement_gate(F.transform("f", lambda x: x["c"]), F.transform("f", lambda x: x["r"]))
    return rounded(wide.select("series", eligible.alias("eligible"), wins.alias("wins"), gain.alias("improvement_pct")))


CALIBRATION = fc.blocks("calibration", N - 84, N - 84, N - 42)
CHOSEN_SQL_ALL = choice_sql() + CHOSEN_SQL


def segment_sql(name):
    return f", {name}_rows AS (SELECT * FROM chosen WHERE segment = '{name}')"


@query("q_error_quantile", "WITH " + DEMAND_SQL + """, actual AS (SELECT series, day_idx % 7 AS weekday, value AS actual, 0 AS predicted FROM demand)"""
       + rank_sql("q50", "actual", "series, weekday", 0.5) + rank_sql("q90", "actual", "series, weekday", 0.9) + """
SELECT a.series, CAST(a.weekday AS INTEGER) AS weekday, a.residuals, CAST(a.half_width AS BIGINT) AS q50, CAST(b.half_width AS BIGINT) AS q90
FROM q50 a JOIN q90 b ON a.series = b.series AND a.weekday = b.weekday""")
def error_quantile(spark, sf_dir):
    from tideline.operators.quantiles import rank_quantiles
    rows = dense(spark, sf_dir).withColumn("weekday", F.col("day_idx") % 7)
    return rank_quantiles(rows, ["series", "weekday"], "value", {"q50": 0.5, "q90": 0.9})


@query("q_calibration", rows_sql(SELECTION + CALIBRATION + TEST) + CHOSEN_SQL_ALL + segment_sql("calibration") + segment_sql("test")
       + rank_sql("width", "calibration_rows", "series", 0.9) + """
SELECT t.series, t.selected_model, round(w.half_width, 6) AS half_width, w.residuals,
  round(100 * avg(CASE WHEN abs(actual - predicted) <= half_width THEN 1.0 ELSE 0.0 END), 6) AS coverage_pct, count(*) AS days
FROM test_rows t JOIN width w ON t.series = w.series GROUP BY ALL""")
def calibration(spark, sf_dir):
    rows = study.predictions(dense(spark, sf_dir), SELECTION + CALIBRATION + TEST)
    choice = study.selected(rows)
    chosen = study.with_choice(rows, choice)
    widths = fc.calibration(chosen.filter("segment = 'calibration'"))
    covered = fc.coverage(chosen.filter("segment = 'test'"), widths.drop("residuals"))
    return rounded(covered.join(widths.select("series", "residuals"), "series").join(choice.select("series", "selected_model"), "series"))


STUDY = study.study_blocks(N)
STUDY_SQL = rows_sql(STUDY) + CHOSEN_SQL_ALL


@query("q_calibration_curve", STUDY_SQL + segment_sql("calibration") + segment_sql("test")
       + "".join(rank_sql(f"w{level}", "calibration_rows", "series", level / 100) for level in fc.NOMINAL_LEVELS)
       + ", levels AS (" + " UNION ALL ".join(f"SELECT series, {level} AS nominal_pct, half_width FROM w{level}" for level in fc.NOMINAL_LEVELS) + """)
SELECT t.series, nominal_pct, round(half_width, 6) AS half_width,
  round(100 * avg(CASE WHEN abs(actual - predicted) <= half_width THEN 1.0 ELSE 0.0 END), 6) AS actual_pct, count(*) AS test_dates
FROM test_rows t JOIN levels l ON l.series = t.series GROUP BY ALL""")
def calibration_curve(spark, sf_dir):
    return rounded(run(spark, sf_dir).calibration_curve())


@query("q_eval_windows", "WITH " + DEMAND_SQL + ", w AS (SELECT * FROM (VALUES "
       + ", ".join(f"('{name}', {a}, {b})" for name, a, b in fc.evaluation_windows(N)) + """) t(window_name, a, b))
SELECT window_name, first_day + CAST(a AS INTEGER) AS start_day, first_day + CAST(b AS INTEGER) AS end_day, count(*) AS observations
FROM w, bounds, demand d WHERE d.day_idx BETWEEN a AND b GROUP BY ALL""")
def eval_windows(spark, sf_dir):
    table = spark.createDataFrame(list(fc.evaluation_windows(N)), "window_name string, a int, b int")
    return (dense(spark, sf_dir).join(F.broadcast(table), F.col("day_idx").between(F.col("a"), F.col("b"))).groupBy("window_name")
            .agg(F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.count("*").alias("observations")))


FORECAST_SQL = STUDY_SQL + segment_sql("calibration") + segment_sql("band") + segment_sql("final") + rank_sql("width", "calibration_rows", "series", 0.9) + """,
banded AS (SELECT *, CASE WHEN horizon <= 7 THEN 1 ELSE 8 END AS horizon_start FROM band_rows)""" + rank_sql("band_width", "banded", "series, horizon_start", 0.9) + """,
published AS (SELECT f.series, f.selected_model, f.target, f.horizon, f.predicted, CAST(round_even(f.predicted, 0) AS BIGINT) AS forecast,
    CAST(greatest(0, floor(f.predicted - w.half_width)) AS BIGINT) AS lower, CAST(ceil(f.predicted + w.half_width) AS BIGINT) AS upper,
    round_even(f.same_weekday, 2) AS same_weekday, round_even(f.four_week_mean, 2) AS four_week_mean, round_even(f.seasonal_ridge, 2) AS seasonal_ridge,
    CAST(greatest(0, floor(greatest(0, f.predicted - b.half_width))) AS BIGINT) AS shadow_lower, CAST(ceil(f.predicted + b.half_width) AS BIGINT) AS shadow_upper
  FROM final_rows f JOIN width w ON w.series = f.series
  JOIN band_width b ON b.series = f.series AND b.horizon_start = CASE WHEN f.horizon <= 7 THEN 1 ELSE 8 END)"""


@query("q_forecast", FORECAST_SQL + """ SELECT series, selected_model, target, horizon, forecast, lower, upper, same_weekday, four_week_mean,
  seasonal_ridge, shadow_lower, shadow_upper FROM published""")
def forecast(spark, sf_dir):
    table = run(spark, sf_dir).forecast()
    shadow = F.element_at("shadow_intervals", F.lit(fc.BAND_METHOD))
    return table.select("series", "selected_model", "target", "horizon", "forecast", "lower", "upper",
                        *[F.element_at("candidates", F.lit(name)).alias(name) for name in fc.CANDIDATES],
                        shadow["lower"].alias("shadow_lower"), shadow["upper"].alias("shadow_upper"))


CAPACITY = 80


@query("q_capacity_excess", FORECAST_SQL + f""" SELECT series, target, forecast, lower, upper, {CAPACITY} AS daily_capacity,
  greatest(0, forecast - {CAPACITY}) AS above_capacity FROM published""")
def capacity_excess(spark, sf_dir):
    return fc.capacity_excess(run(spark, sf_dir).forecast(), CAPACITY)


@query("q_capacity_curve", FORECAST_SQL + """, tops AS (SELECT series, greatest(1, max(upper)) AS top FROM published GROUP BY series)
SELECT p.series, CAST(step AS INTEGER) AS step, round(step * top / 60.0, 6) AS capacity, round(sum(greatest(0, forecast - step * top / CAST(60 AS DOUBLE))), 6) AS forecast_excess,
  round(sum(greatest(0, upper - step * top / CAST(60 AS DOUBLE))), 6) AS upper_excess
FROM published p JOIN tops t ON t.series = p.series, (SELECT unnest(range(0, 61)) AS step) GROUP BY p.series, step, top""")
def capacity_curve(spark, sf_dir):
    return rounded(fc.capacity_curve(run(spark, sf_dir).forecast()))


@query("q_shadow_interval", STUDY_SQL + segment_sql("band") + """, banded AS (SELECT *, CASE WHEN horizon <= 7 THEN 1 ELSE 8 END AS horizon_start FROM band_rows)"""
       + rank_sql("band_width", "banded", "series, horizon_start", 0.9) + """
SELECT series, CAST(horizon_start AS INTEGER) AS horizon_start, CAST(CASE WHEN horizon_start = 1 THEN 7 ELSE 14 END AS INTEGER) AS horizon_end, residuals, round(half_width, 6) AS half_width FROM band_width""")
def shadow_interval(spark, sf_dir):
    return rounded(run(spark, sf_dir).shadow_widths())


BANDED_SQL = STUDY_SQL + segment_sql("band") + segment_sql("replay") + """, banded AS (SELECT *, CASE WHEN horizon <= 7 THEN 1 ELSE 8 END AS horizon_start FROM band_rows)""" + rank_sql(
    "band_width", "banded", "series, horizon_start", 0.9) + """, bounded AS (SELECT r.series, r.origin, r.target, r.horizon, r.actual, predicted,
    greatest(0, predicted - half_width) AS lower, predicted + half_width AS upper FROM replay_rows r
  JOIN band_width b ON b.series = r.series AND b.horizon_start = CASE WHEN r.horizon <= 7 THEN 1 ELSE 8 END)"""


def bounded_replay(spark, sf_dir):
    tables = run(spark, sf_dir)
    return fc.band_bounds(tables.part("replay"), tables.shadow_widths())


@query("q_band_bounds", BANDED_SQL + """ SELECT series, origin, target, horizon, actual, round(predicted, 6) AS predicted, round(lower, 6) AS lower,
  round(upper, 6) AS upper FROM bounded""")
def band_bounds(spark, sf_dir):
    return rounded(bounded_replay(spark, sf_dir).select("series", "origin", "target", "horizon", "actual", "predicted", "lower", "upper"))


SCORE_SQL = """count(*) AS predictions, count(DISTINCT target) AS distinct_target_dates,
  round(100 * avg(CASE WHEN actual BETWEEN lower AND upper THEN 1.0 ELSE 0.0 END), 6) AS coverage_pct, round(avg(upper - lower), 6) AS mean_width,
  round(avg(upper - lower + 20 * greatest(lower - actual, 0) + 20 * greatest(actual - upper, 0)), 6) AS mean_interval_score"""


@query("q_interval_score", BANDED_SQL + f" SELECT series, {SCORE_SQL} FROM bounded GROUP BY series")
def interval_score(spark, sf_dir):
    return rounded(fc.interval_score(bounded_replay(spark, sf_dir), ["series"]))


WINDOWED_SQL = rows_sql(study.interval_blocks(N)).replace(
    "evaluated AS (SELECT f.series,", "tagged AS (SELECT f.series,") + """,
evaluated AS (SELECT *, split_part(segment, '|', 1) AS kind, CAST(split_part(segment, '|', 2) AS INTEGER) AS win,
  CAST(split_part(segment, '|', 3) AS INTEGER) AS first FROM tagged)""" + choice_sql("kind LIKE 'select%'", "series, win", "kind").replace(
    "SELECT series, segment, horizon", "SELECT series, segment, kind, win, horizon") + """,
chosen AS (SELECT e.*, c.selected_model, CASE c.selected_model WHEN 'same_weekday' THEN same_weekday WHEN 'four_week_mean' THEN four_week_mean
    ELSE seasonal_ridge END AS predicted FROM evaluated e JOIN choice c ON c.series = e.series AND c.win = e.win),
points AS (SELECT * FROM chosen WHERE kind = 'point'), olds AS (SELECT * FROM chosen WHERE kind = 'old'),
bands AS (SELECT *, CASE WHEN horizon <= 7 THEN 1 ELSE 8 END AS horizon_start FROM chosen WHERE kind = 'band')""" + rank_sql(
    "old_width", "olds", "series, win, first", 0.9) + rank_sql("band_width", "bands", "series, win, first, horizon_start", 0.9) + """,
bounded AS (SELECT 'reference' AS method, p.*, greatest(0, predicted - half_width) AS lower, predicted + half_width AS upper
  FROM points p JOIN old_width w USING (series, win, first)
  UNION ALL SELECT 'recent', p.*, greatest(0, predicted - half_width), predicted + half_width FROM points p JOIN band_width w
    ON w.series = p.series AND w.win = p.win AND w.first = p.first AND w.horizon_start = CASE WHEN p.horizon <= 7 THEN 1 ELSE 8 END)"""


@query("q_interval_study", WINDOWED_SQL + f' SELECT series, win AS "window", selected_model, method, {SCORE_SQL} FROM bounded GROUP BY ALL')
def interval_study(spark, sf_dir):
    return rounded(study.interval_study(dense(spark, sf_dir), N))


REPLAY_SQL = STUDY_SQL + segment_sql("replay")


@query("q_replay", REPLAY_SQL + """ SELECT series, origin, origin + 2 AS issued, CAST(horizon - 2 AS INTEGER) AS lead, target,
  CAST(isodow(target) - 1 AS INTEGER) AS weekday, actual, round(predicted, 6) AS predicted FROM replay_rows""")
def replay(spark, sf_dir):
    rows = run(spark, sf_dir).part("replay")
    return rounded(rows.select("series", "origin", F.date_add("origin", 2).alias("issued"), (F.col("horizon") - 2).alias("lead"), "target",
                               F.weekday("target").alias("weekday"), "actual", "predicted"))


HEAT_SQL = REPLAY_SQL + """, cells AS (SELECT series, CAST(isodow(target) - 1 AS INTEGER) AS weekday,
    CASE WHEN horizon - 2 <= 3 THEN '1–3' WHEN horizon - 2 <= 7 THEN '4–7' ELSE '8–14' END AS lead, count(*) AS predictions,
    count(DISTINCT target) AS dates, 100 * sum(abs(actual - predicted)) / nullif(sum(actual), 0) AS wape_pct FROM replay_rows GROUP BY 1, 2, 3)"""


@query("q_error_heatmap", HEAT_SQL + """ SELECT s.series, CAST(w.weekday AS INTEGER) AS weekday, l.lead, coalesce(predictions, 0) AS predictions, coalesce(dates, 0) AS dates,
  round(wape_pct, 6) AS wape_pct FROM (SELECT DISTINCT series FROM replay_rows) s, (SELECT unnest(range(0, 7)) AS weekday) w,
  (VALUES ('1–3'), ('4–7'), ('8–14')) l(lead) LEFT JOIN cells c ON c.series = s.series AND c.weekday = w.weekday AND c.lead = l.lead""")
def error_heatmap(spark, sf_dir):
    return rounded(run(spark, sf_dir).heatmap())


@query("q_worst_cell", HEAT_SQL + """ SELECT series, weekday, lead, round(wape_pct, 6) AS wape_pct, dates FROM (SELECT *, row_number() OVER
  (PARTITION BY series ORDER BY wape_pct DESC, weekday, lead DESC) AS r FROM cells WHERE wape_pct IS NOT NULL) WHERE r = 1""")
def worst_cell(spark, sf_dir):
    return rounded(fc.worst_cell(run(spark, sf_dir).heatmap()))


@query("q_replay_weekly", REPLAY_SQL + """ SELECT series, target - CAST(isodow(target) - 1 AS INTEGER) AS week, round(avg(abs(actual - predicted)), 6) AS mae,
  round(100 * sum(abs(actual - predicted)) / nullif(sum(actual), 0), 6) AS wape_pct, count(*) AS days FROM replay_rows GROUP BY 1, 2""")
def replay_weekly(spark, sf_dir):
    return rounded(fc.weekly_errors(run(spark, sf_dir).part("replay")))
