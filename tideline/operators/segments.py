"""Ordered scans over keys of any size.

``lag``, running totals and "last value so far" need an order, and a window over the bare key would
send a hot key (one incident holding a third of the log) to a single task. Here every scan runs twice:
once inside short segments of a key, which spreads the key over the cluster, and once over one summary
row per segment. The second pass sees at most one row per segment, whatever the number of events.
"""
from pyspark.sql import Window
from pyspark.sql import functions as F


def running_before(segments, keys, order, **totals):
    """Add ``name = sum(column)`` over all earlier segments of the key (0 for the first)."""
    window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = segments
    for name, column in totals.items():
        out = out.withColumn(name, F.coalesce(F.sum(column).over(window), F.lit(0)))
    return out


def first_per_key(rows, keys, segment, order, limit):
    """Exactly the first ``limit`` rows of each key, for keys of any size.

    Counts per segment find the one segment in which a key crosses the limit; only that one is ranked.
    """
    sizes = rows.groupBy(*keys, segment).agg(F.count("*").alias("_n"))
    sizes = running_before(sizes, keys, segment, _before="_n").filter(F.col("_before") < limit)
    kept = rows.join(sizes, [*keys, segment])
    whole = kept.filter(F.col("_before") + F.col("_n") <= limit)
    rank = F.row_number().over(Window.partitionBy(*keys, segment).orderBy(*order))
    crossing = (kept.filter(F.col("_before") + F.col("_n") > limit)
                .withColumn("_rank", rank).filter(F.col("_before") + F.col("_rank") <= limit).drop("_rank"))
    return whole.unionByName(crossing).drop("_n", "_before")


def cumulative(rows, keys, order, bucket, column, name, descending=False):
    """Running sum of ``column`` along ``order`` inside ``keys``, current row included.

    ``bucket`` must be a coarsening of ``order``. One pass runs inside buckets, one over bucket totals.
    """
    direction = F.desc if descending else F.asc
    inside = Window.partitionBy(*keys, bucket).orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, bucket).agg(F.sum(column).alias("_total"))
    totals = running_before(totals, keys, direction(bucket), _carry="_total").drop("_total")
    return (rows.withColumn("_run", F.sum(column).over(inside)).join(totals, [*keys, bucket])
            .withColumn(name, F.col("_run") + F.col("_carry")).drop("_run", "_carry"))
