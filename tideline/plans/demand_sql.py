"""SQL statements of the forecasting results, written independently of the Spark plans (joins instead of windows,
elimination by recursion instead of a solver)."""

N = 730

DEMAND_SQL = """bounds AS (SELECT CAST(max(l_shipdate) AS DATE) - 1 AS last_day, CAST(max(l_shipdate) AS DATE) - 730 AS first_day FROM lineitem),
counted AS (SELECT l_linestatus AS series, CAST(l_shipdate AS DATE) AS day, count(*) AS value FROM lineitem, bounds
  WHERE l_shipdate >= first_day AND l_shipdate < last_day + 1 GROUP BY 1, 2),
demand AS (SELECT series, day, CAST(date_diff('day', first_day, day) AS INTEGER) AS day_idx, value
  FROM (SELECT * FROM counted UNION ALL SELECT 'TOTAL', day, CAST(sum(value) AS BIGINT) FROM counted GROUP BY day), bounds)"""

OBS_SQL = DEMAND_SQL + """, panel_rows AS (
  SELECT *, avg(value) OVER (PARTITION BY series ORDER BY day_idx RANGE BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean7,
    avg(value) OVER (PARTITION BY series ORDER BY day_idx RANGE BETWEEN 27 PRECEDING AND CURRENT ROW) AS mean28 FROM demand),
obs AS (
  SELECT o.series, o.day_idx, o.day, CAST(h.horizon AS INTEGER) AS horizon, o.day + CAST(h.horizon AS INTEGER) AS target, o.mean7, o.mean28,
    CAST(a.value AS DOUBLE) AS lag1, CAST(b.value AS DOUBLE) AS lag2, CAST(c.value AS DOUBLE) AS lag3, CAST(d.value AS DOUBLE) AS lag4,
    f.value AS actual
  FROM panel_rows o CROSS JOIN (SELECT unnest(range(1, 15)) AS horizon) h
  JOIN demand a ON a.series = o.series AND a.day_idx = o.day_idx + h.horizon - 7 * ceil(h.horizon / 7.0)
  JOIN demand b ON b.series = a.series AND b.day_idx = a.day_idx - 7
  JOIN demand c ON c.series = a.series AND c.day_idx = a.day_idx - 14
  JOIN demand d ON d.series = a.series AND d.day_idx = a.day_idx - 21
  LEFT JOIN demand f ON f.series = o.series AND f.day_idx = o.day_idx + h.horizon
  WHERE o.day_idx >= 27)"""

SEASON = """sin(2 * pi() * (isodow(target) - 1) / 7) AS sin_week, cos(2 * pi() * (isodow(target) - 1) / 7) AS cos_week,
    sin(2 * pi() * dayofyear(target) / 365.25) AS sin_year, cos(2 * pi() * dayofyear(target) / 365.25) AS cos_year, horizon / 14.0 AS lead"""

CORE_SQL = OBS_SQL + f""", feat AS (SELECT *, {SEASON} FROM obs)"""

CORE_LIST = "lag1 / scale, lag2 / scale, lag3 / scale, lag4 / scale, mean7 / scale, mean28 / scale, sin_week, cos_week, sin_year, cos_year, lead"
EXTRA_LIST = ", holiday, holiday_before, holiday_after, temperature_lag, rain_lag"

HOLIDAY_SQL = """years AS (SELECT CAST(unnest(range(1990, 2030)) AS INTEGER) AS y),
fixed AS (SELECT make_date(y, m, d) AS day FROM years, (VALUES (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) t(m, d)),
holidays AS (SELECT day FROM fixed UNION SELECT day - 1 FROM fixed WHERE isodow(day) = 6 UNION SELECT day + 1 FROM fixed WHERE isodow(day) = 7
  UNION SELECT make_date(y, m, 1) + CAST((w + 1 - isodow(make_date(y, m, 1)) + 7) % 7 + 7 * (k - 1) AS INTEGER)
    FROM years, (VALUES (1, 0, 3), (2, 0, 3), (9, 0, 1), (10, 0, 2), (11, 3, 4)) t(m, w, k)
  UNION SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) FROM years)"""

COVARIATE_SQL = """covariates AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS temperature, avg(l_discount) AS rain
  FROM lineitem GROUP BY 1)"""

CHALLENGER_SQL = HOLIDAY_SQL + ", " + COVARIATE_SQL + ", " + CORE_SQL.replace("feat AS", "core_feat AS") + """, lagged AS (
  SELECT o.day, sum(c.temperature) / 140.0 AS temperature_lag, sum(c.rain) / 140.0 AS rain_lag FROM (SELECT DISTINCT day FROM demand) o
  JOIN covariates c ON c.day BETWEEN o.day - 11 AND o.day - 5 GROUP BY o.day HAVING count(*) = 7),
feat AS (SELECT f.*, l.temperature_lag, l.rain_lag,
    CASE WHEN f.target IN (SELECT day FROM holidays) THEN 1.0 ELSE 0.0 END AS holiday,
    CASE WHEN f.target - 1 IN (SELECT day FROM holidays) THEN 1.0 ELSE 0.0 END AS holiday_before,
    CASE WHEN f.target + 1 IN (SELECT day FROM holidays) THEN 1.0 ELSE 0.0 END AS holiday_after
  FROM core_feat f JOIN lagged l ON l.day = f.day)"""


def gram_sql(ends, extra=False):
    size = 17 if extra else 12
    features = "[1.0, " + CORE_LIST + (EXTRA_LIST if extra else "") + "]"
    return (CHALLENGER_SQL if extra else CORE_SQL) + f""", ends AS (SELECT unnest([{', '.join(map(str, ends))}]) AS fit_end),
scales AS (SELECT series, fit_end, greatest(1.0, avg(value)) AS scale FROM demand, ends WHERE day_idx < fit_end GROUP BY 1, 2),
scaled AS (SELECT f.series, s.fit_end, s.scale, f.day_idx, {features} AS x, actual / scale AS y
  FROM feat f JOIN scales s ON s.series = f.series WHERE day_idx >= 55 AND (day_idx - 55) % 7 = 0 AND day_idx < s.fit_end - 14),
augmented AS (SELECT series, fit_end, scale, list_append(x, y) AS x FROM scaled),
sums AS (SELECT series, fit_end, scale, i, j, sum(x[i] * x[j]) AS v, count(*) AS samples
  FROM augmented, (SELECT unnest(range(1, {size + 1})) AS i), (SELECT unnest(range(1, {size + 2})) AS j) GROUP BY ALL)"""


def fits_sql(ends, extra=False):
    size = 17 if extra else 12
    return gram_sql(ends, extra) + f""", matrix_rows AS (SELECT series, fit_end, scale, i,
    list(v + CASE WHEN i <> j THEN 0 WHEN i = 1 THEN 1e-8 ELSE 8 END ORDER BY j) AS r FROM sums GROUP BY ALL),
steps AS (SELECT series, fit_end, scale, CAST(0 AS BIGINT) AS k, list(r ORDER BY i) AS m FROM matrix_rows GROUP BY ALL
  UNION ALL SELECT series, fit_end, scale, k + 1, list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 2}), lambda j:
    CASE WHEN i = k + 1 THEN m[k + 1][j] / m[k + 1][k + 1] ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END))
  FROM steps WHERE k < {size}),
fits AS (SELECT series, fit_end, scale, list_transform(m, lambda r: r[{size + 1}]) AS coefficients FROM steps WHERE k = {size})"""


def rows_sql(blocks, extra=False):
    """Evaluation rows ``evaluated(series, segment, fit_end, origin_idx, origin, horizon, target, actual, candidates…)``."""
    features = "[1.0, " + CORE_LIST + (EXTRA_LIST if extra else "") + "]"
    ends = sorted({block[2] for block in blocks})
    values = ", ".join(f"({o}, '{s}', {e}, {lo}, {hi})" for o, s, e, lo, hi in blocks)
    name = "weather_calendar_ridge" if extra else "seasonal_ridge"
    return "WITH RECURSIVE " + fits_sql(ends, extra) + f""", specs(origin_idx, segment, fit_end, low, high) AS (VALUES {values}),
evaluated AS (SELECT f.series, s.segment, s.fit_end, s.origin_idx, f.day AS origin, f.horizon, f.target, f.actual,
    lag1 AS same_weekday, (lag1 + lag2 + lag3 + lag4) / 4 AS four_week_mean,
    greatest(0.0, scale * list_dot_product(CAST({features} AS DOUBLE[]), CAST(coefficients AS DOUBLE[]))) AS {name}
  FROM feat f JOIN specs s ON f.day_idx = s.origin_idx AND f.horizon BETWEEN s.low AND s.high
  JOIN fits t ON t.series = f.series AND t.fit_end = s.fit_end)"""


LONG_SQL = """, candidates AS (
  SELECT series, segment, horizon, target, actual, 'same_weekday' AS candidate, same_weekday AS predicted FROM evaluated
  UNION ALL SELECT series, segment, horizon, target, actual, 'four_week_mean', four_week_mean FROM evaluated
  UNION ALL SELECT series, segment, horizon, target, actual, 'seasonal_ridge', seasonal_ridge FROM evaluated)"""


def choice_sql(segments="segment LIKE 'select%'", keys="series", fold="segment"):
    """Two-stage selection from fold errors."""
    return LONG_SQL + f""", folds AS (SELECT {keys}, {fold} AS fold, candidate, avg(abs(actual - predicted)) AS mae FROM candidates
  WHERE {segments} GROUP BY ALL),
wide AS (SELECT {keys}, fold, max(mae) FILTER (WHERE candidate = 'same_weekday') AS w,
    max(mae) FILTER (WHERE candidate = 'four_week_mean') AS m, max(mae) FILTER (WHERE candidate = 'seasonal_ridge') AS r FROM folds GROUP BY ALL),
stage AS (SELECT {keys}, sum(w) AS sw, sum(m) AS sm, sum(r) AS sr, CAST(count(*) FILTER (WHERE w < m) AS INTEGER) AS w_wins,
    CAST(count(*) FILTER (WHERE r < m) AS INTEGER) AS rm_wins, CAST(count(*) FILTER (WHERE r < w) AS INTEGER) AS rw_wins FROM wide GROUP BY ALL),
gated AS (SELECT *, sm > 0 AND sw <= 0.98 * sm AND w_wins >= 2 AS weekday_ok FROM stage),
decided AS (SELECT *, CASE WHEN weekday_ok THEN 'same_weekday' ELSE 'four_week_mean' END AS baseline,
    CASE WHEN weekday_ok THEN sw ELSE sm END AS reference, CASE WHEN weekday_ok THEN rw_wins ELSE rm_wins END AS r_wins FROM gated),
choice AS (SELECT {keys}, weekday_ok AS baseline_eligible, w_wins AS baseline_wins, 100 * (1 - sw / nullif(sm, 0)) AS baseline_improvement_pct,
    baseline, reference > 0 AND sr <= 0.98 * reference AND r_wins >= 2 AS regression_eligible, r_wins AS regression_wins,
    100 * (1 - sr / nullif(reference, 0)) AS regression_improvement_pct,
    CASE WHEN reference > 0 AND sr <= 0.98 * reference AND r_wins >= 2 THEN 'seasonal_ridge' ELSE baseline END AS selected_model FROM decided)"""


CHOSEN_SQL = """, chosen AS (SELECT e.*, c.selected_model, CASE c.selected_model WHEN 'same_weekday' THEN same_weekday
    WHEN 'four_week_mean' THEN four_week_mean ELSE seasonal_ridge END AS predicted FROM evaluated e JOIN choice c ON c.series = e.series)"""


def rank_sql(name, source, keys, level):
    """Rank quantile of absolute errors."""
    return f""", {name}_ranked AS (SELECT {keys}, abs(actual - predicted) AS error,
    row_number() OVER (PARTITION BY {keys} ORDER BY abs(actual - predicted)) AS r, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}),
{name} AS (SELECT {keys}, error AS half_width, n AS residuals FROM {name}_ranked WHERE r = least(n, CAST(ceil((n + 1) * CAST({level} AS DOUBLE)) AS BIGINT)))"""
