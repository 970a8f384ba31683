"""What merges leave on disk, and the bit sets behind that."""
import os

import pytest
from pyspark.sql import functions as F

from tideline import session
from tideline.operators import merge
from tideline.operators.sieve import Sieve, without
from tideline.plans import delivery_queries as queries

ROWS = 20_000


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """``lineitem`` and ``events`` in which some lines come again, with other revisions or the same."""
    root = str(tmp_path_factory.mktemp("lines"))
    n = F.col("id")
    line = F.when(n % 4 == 0, n - n % 40).otherwise(n)
    (spark.range(ROWS).select(
        (line % 15000).alias("l_orderkey"), (n * 7919 % 2000).alias("l_partkey"), (n * 104729 % 100).alias("l_suppkey"), (line % 7).cast("int").alias("l_linenumber"),
        *[(F.xxhash64(n, F.lit(c)) % 9000 / 100).alias(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax")],
        F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"),
        F.expr("TIMESTAMP_NTZ '1995-01-02 00:00:00' + make_dt_interval(cast(id * 31 % 2400 AS int))").alias("l_shipdate"))
     .write.parquet(f"{root}/lineitem.parquet"))
    (spark.range(100).select(n.alias("event_id"), (n % 9).alias("user_id"), F.lit("view").alias("event_type"), (n * 1.0).alias("value"), F.lit('{"k": 3}').alias("props"),
                             F.expr("TIMESTAMP_NTZ '2024-01-05 00:00:00'").alias("ts")).write.parquet(f"{root}/events.parquet"))
    return root


def kept_bytes(folder):
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(folder) for name in names if name.endswith(".parquet"))


@pytest.mark.parametrize("name", ["merge_events", "current_events", "late_arrivals", "merge_stats"])
def test_a_merge_keeps_few_bytes_a_delivery(spark, tables, tmp_path, monkeypatch, name):
    monkeypatch.setattr(session, "scratch_root", lambda spark: str(tmp_path))
    assert getattr(queries, name)(spark, tables).count() > 0
    assert kept_bytes(tmp_path) < 130 * ROWS


@pytest.mark.parametrize("most", [64, 1 << 20])
def test_bit_sets_part_rows_and_without_is_exact(spark, most):
    """A set of 64 bits over 300 keys lets all rows through."""
    rows = spark.range(1000).selectExpr("id AS k", "nullif(id % 5, 0) AS l", "concat('payload ', id) AS text")
    gone = rows.filter("k % 3 = 0").select("k", "l")
    near, clear = Sieve(gone, ["k", "l"], most).split(rows)
    assert near.unionByName(clear).count() == 1000 and near.filter("k % 3 = 0").count() == 334
    left = without(rows, gone, ["k", "l"], most=most)
    assert sorted(r["k"] for r in left.collect()) == [k for k in range(1000) if k % 3 or k % 5 == 0]


def test_names_of_any_kind_survive_an_exchange(spark):
    """Names that are no hexadecimal digits, or an odd number of them, or in capitals."""
    names = ["ab" * 32, "abc", "AB", "", "e-1", "0a"]
    rows = [(name, revision) for name in names for revision in (1, 2, 2)] + [(None, 1), ("ab", None)]
    found = merge.current_events(spark.createDataFrame(rows, "event_id string, revision int")).collect()
    assert sorted((r["event_id"], r["revision"]) for r in found) == sorted((name, 2) for name in names for _ in range(2))
    back = merge._unpacked(merge._packed(spark.createDataFrame([(name,) for name in names], "event_id string"))).collect()
    assert sorted(r["event_id"] for r in back) == sorted(names)
