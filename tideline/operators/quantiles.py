"""Exact percentiles by distributed selection, and rank quantiles of small calibration sets."""
from pyspark.sql import Window
from pyspark.sql import functions as F


def exact_percentiles(rows, keys, value, probabilities, width=1.0 / 60):
    """Linear-interpolated percentiles per key without holding a key's values in one place.

    ``probabilities`` maps output column to probability. Equal values collapse to counts first; counts per
    value bucket of ``width`` locate the two ranks wanted; only the buckets holding them are then ordered.
    """
    counts = (rows.filter(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
              .withColumn("_b", F.floor(F.col("_v") / F.lit(width))))
    by_key = Window.partitionBy(*keys)
    ordered = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"))
                                 for name, p in probabilities.items()]))
    buckets = (counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
               .withColumn("_upto", F.sum("_bn").over(ordered))
               .withColumn("_all", F.sum("_bn").over(by_key))
               .select("*", wanted.alias("_q"))
               .withColumn("_pos", (F.col("_all") - 1) * F.col("_q.p"))
               .filter((F.col("_upto") > F.floor("_pos")) & (F.col("_upto") - F.col("_bn") <= F.ceil("_pos")))
               .select(*keys, "_b", F.col("_q.name").alias("_name"), "_pos",
                       (F.col("_upto") - F.col("_bn")).alias("_before")))
    run = (Window.partitionBy(*keys, "_b", "_name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = (counts.join(buckets, [*keys, "_b"])
             .withColumn("_cum", F.col("_before") + F.sum("_n").over(run))
             .groupBy(*keys, "_name").agg(
                 F.max("_pos").alias("_pos"),
                 F.min(F.when(F.col("_cum") > F.floor("_pos"), F.col("_v"))).alias("_lo"),
                 F.min(F.when(F.col("_cum") > F.ceil("_pos"), F.col("_v"))).alias("_hi"))
             .withColumn("_value", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))))
    return found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in probabilities])


def rank_quantiles(rows, keys, error, levels):
    """Sorted error at rank ``min(n, ceil((n + 1) * level))`` per key.

    Meant for calibration sets (a fixed number of days per key), hence a plain window.
    ``levels`` maps output column to level.
    """
    window = Window.partitionBy(*keys)
    ranked = (rows.withColumn("_rank", F.row_number().over(window.orderBy(error)))
              .withColumn("_n", F.count("*").over(window)))
    picks = []
    for name, level in levels.items():
        rank = F.least(F.col("_n"), F.ceil((F.col("_n") + 1) * F.lit(float(level))))
        picks.append(F.max(F.when(F.col("_rank") == rank, F.col(error))).alias(name))
    return ranked.groupBy(*keys).agg(F.count("*").alias("residuals"), *picks)
