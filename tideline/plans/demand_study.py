"""The daily forecast workload over all series at once, and the retrospective band study."""
from pyspark.sql import functions as F

from tideline.functions.calendar import holidays_between
from tideline.operators import forecast as fc
from tideline.operators.demand import lagged_covariates
from tideline.session import materialize

CHALLENGER_NAMES = fc.CORE + fc.EXTRA


def study_blocks(n):
    """Every evaluation of the daily run: selection folds, calibration, test, replay, bands and the final forecast."""
    frozen, calibrated = n - 84, n - 42
    return (fc.selection_blocks(frozen) + fc.blocks("calibration", frozen, frozen, calibrated)
            + fc.blocks("test", frozen, calibrated, n) + fc.replay_blocks(n, calibrated, frozen)
            + fc.band_blocks(n) + fc.final_blocks(n))


def fit_ends(blocks):
    return sorted({block[2] for block in blocks})


def predictions(series, blocks):
    """Evaluated rows of all blocks with the three candidates; written once, since every summary reads them."""
    origins = fc.panel(series)
    fits = fc.fit(series, origins, fit_ends(blocks))
    return materialize(fc.evaluation_columns(fc.evaluate(origins, fits, blocks)), "predictions")


def challenger_features(series, covariates):
    """Preparation step adding holiday and covariate columns; ``covariates`` is one row per calendar day."""
    first, last = series.agg(F.min("day"), F.max("day")).first()
    calendar = holidays_between(series.sparkSession, first, last)
    lagged = lagged_covariates(covariates)
    return lambda rows: fc.with_challenger_features(fc.with_features(rows), lagged, calendar)


def challenger_predictions(series, covariates, blocks):
    origins = fc.panel(series)
    prepare = challenger_features(series, covariates)
    fits = fc.fit(series, origins, fit_ends(blocks), prepare, CHALLENGER_NAMES)
    rows = fc.evaluate(origins, fits, blocks, prepare, CHALLENGER_NAMES, candidate=fc.CHALLENGER)
    return fc.evaluation_columns(rows, (*fc.BASELINES, fc.CHALLENGER))


def selected(rows):
    """Model choice per series from the selection folds."""
    folds = rows.filter(F.col("segment").startswith("select"))
    return fc.select_models(fc.long_candidates(folds))


def with_choice(rows, choice):
    """Prediction of the selected model; one choice row per series."""
    return rows.join(choice.select("series", "selected_model"), "series").withColumn("predicted", fc.chosen_value())


class Study:
    """Lazy tables of one run; ``rows`` and ``choice`` are stored, the rest are small aggregates of them."""

    def __init__(self, series, n):
        self.n = n
        self.rows = predictions(series, study_blocks(n))
        self.choice = materialize(selected(self.rows), "choice")
        self.chosen = with_choice(self.rows, self.choice)

    def part(self, segment):
        return self.chosen.filter(F.col("segment") == segment)

    def widths(self):
        return fc.calibration(self.part("calibration"))

    def shadow_widths(self):
        return fc.band_widths(self.part("band"))

    def forecast(self):
        return fc.forecast_table(self.part("final"), self.widths(), self.shadow_widths())

    def test_metrics(self):
        return fc.error_metrics(fc.long_candidates(self.rows.filter(F.col("segment") == "test")), ["series", "candidate"])

    def calibration_curve(self):
        return fc.calibration_curve(self.part("calibration"), self.part("test"))

    def coverage(self):
        return fc.coverage(self.part("test"), self.widths())

    def heatmap(self):
        return fc.error_heatmap(self.part("replay"))


def interval_blocks(n):
    """Blocks of four 28-day windows; the segment names kind, window and block as ``kind|window|first``."""
    if n < 500:
        raise ValueError("The study of four windows needs 500 days or more")
    found = []
    for window, end in enumerate(range(n - 84, n + 1, 28)):
        start = end - 28
        for i, first in enumerate(fc.selection_ends(start - 84)):
            found += fc.blocks(f"select{i}|{window}|0", first, first, first + fc.FOLD_DAYS)
        for first in range(start, end, fc.HORIZON):
            found.append((first - 1, f"point|{window}|{first}", first, 3, fc.HORIZON))
            found += fc.blocks(f"old|{window}|{first}", first - 84, first - 84, first - 42)
            found += fc.band_blocks(first, f"band|{window}|{first}")
    return found


def interval_study(series, n):
    """Reference and recent bands around the same point forecasts, scored per series, window and method."""
    rows = predictions(series, interval_blocks(n))
    part = F.split("segment", r"\|")
    rows = rows.withColumns({"kind": part[0], "window": part[1].cast("int"), "first": part[2].cast("int")})
    folds = rows.filter(F.col("kind").startswith("select")).withColumn("segment", F.col("kind"))
    choice = materialize(fc.select_models(fc.long_candidates(folds), ("series", "window")), "choice")
    chosen = (rows.filter(~F.col("kind").startswith("select"))
              .join(choice.select("series", "window", "selected_model"), ["series", "window"])
              .withColumn("predicted", fc.chosen_value()))
    keys = ["series", "window", "first"]
    points = chosen.filter("kind = 'point'")
    old = fc.calibration(chosen.filter("kind = 'old'"), keys).select(*keys, "half_width")
    reference = (points.join(old, keys).withColumn("lower", F.greatest(F.lit(0.0), F.col("predicted") - F.col("half_width")))
                 .withColumn("upper", F.col("predicted") + F.col("half_width")))
    recent = fc.band_bounds(points, fc.band_widths(chosen.filter("kind = 'band'"), keys), keys)
    columns = ["series", "window", "selected_model", "target", "actual", "lower", "upper"]
    both = (reference.select(F.lit("reference").alias("method"), *columns)
            .unionByName(recent.select(F.lit("recent").alias("method"), *columns)))
    return fc.interval_score(both, ["series", "window", "selected_model", "method"])
