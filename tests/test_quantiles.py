import random

import numpy as np
import pytest

from tideline.operators.quantiles import exact_percentiles, rank_quantiles
from tideline.operators.segments import cumulative, first_per_key
from pyspark.sql import functions as F


@pytest.mark.parametrize("width", [1.0 / 60, 5.0, 1000.0])
def test_percentiles_equal_numpy_for_hot_and_small_groups(spark, width):
    source = random.Random(5)
    rows = [("hot", source.choice([1.0, 2.5, source.uniform(0, 50)])) for _ in range(400)]
    rows += [(f"g{i % 20}", source.uniform(-3, 90)) for i in range(200)] + [("one", 4.0), ("none", None)]
    frame = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: r for r in exact_percentiles(frame, ["g"], "v", {"p50": 0.5, "p90": 0.9}, width).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g]["p50"] == pytest.approx(np.percentile(values, 50))
        assert found[g]["p90"] == pytest.approx(np.percentile(values, 90))


def test_rank_quantile_of_42_errors(spark):
    frame = spark.createDataFrame([("s", float(i)) for i in range(42)], "series string, error double")
    row = rank_quantiles(frame, ["series"], "error", {"w": 0.9, "all": 1.0}).first()
    assert (row["residuals"], row["w"], row["all"]) == (42, 38.0, 41.0)


def test_first_per_key_keeps_exactly_the_first_rows(spark):
    rows = [("d1", i // 10, i) for i in range(97)] + [("d2", 0, i) for i in range(5)]
    kept = first_per_key(spark.createDataFrame(rows, "day string, minute int, id int"), ["day"], "minute", ["id"], 34).collect()
    assert sorted(r["id"] for r in kept if r["day"] == "d1") == list(range(34))
    assert len([r for r in kept if r["day"] == "d2"]) == 5


def test_cumulative_sums_across_buckets(spark):
    values = [3, 1, 4, 1, 5, 9, 2, 6]
    frame = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, t int, v int").withColumn("b", F.floor(F.col("t") / 3))
    up = {r["t"]: r["c"] for r in cumulative(frame, ["k"], "t", "b", "v", "c").collect()}
    down = {r["t"]: r["c"] for r in cumulative(frame, ["k"], "t", "b", "v", "c", descending=True).collect()}
    assert [up[i] for i in range(8)] == list(np.cumsum(values))
    assert [down[i] for i in range(8)] == list(np.cumsum(values[::-1])[::-1])
