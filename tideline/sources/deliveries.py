"""Delivery batches: packaging, reading, verification against the registry, selection."""
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.text import is_sha256
from tideline.functions.timecols import parse_day_first, week_end
from tideline.operators.normalize import REQUIRED, envelope_violations
from tideline.session import exists, materialize, qualified
from tideline.sources.audit_csv import file_fingerprints, plain_path

# Registry schema version, default day of rows whose update time cannot be read, landing prefix.
REGISTRY_VERSION = 2
DEFAULT_DAY = "2016-03-01"
LANDING = "landing/"

ENVELOPE = T.StructType([
    T.StructField("source_sha256", T.StringType()), T.StructField("source_row", T.VariantType()),
    T.StructField("revision", T.VariantType()), T.StructField("record", T.VariantType())])


def weekly_envelopes(raw):
    """Raw rows as first-revision envelopes, assigned to the week ending on Sunday of their update time."""
    data = [name for name in raw.columns if name not in ("source_sha256", "source_row")]
    day = F.coalesce(F.to_date(parse_day_first(F.col("sys_updated_at"))), F.lit(DEFAULT_DAY).cast("date"))
    return raw.select(week_end(day).alias("week_end"), "source_sha256", "source_row", F.lit(1).alias("revision"),
                      F.struct(*data).alias("record"))


def weekly_registry(envelopes):
    """One registry row per weekly delivery, available at the end of its Sunday."""
    day = F.date_format("week_end", "yyyy-MM-dd")
    return (envelopes.groupBy("week_end").agg(F.count("*").alias("rows"))
            .select(F.concat(F.lit("batch-"), day).alias("batch_id"), "rows",
                    F.concat(day, F.lit(" 23:59:59")).alias("available_as_of"), "week_end"))


def write_deliveries(envelopes, path, rows_per_file=1_000_000):
    """Gzip JSON lines partitioned by week. A large week becomes several files instead of one task's work."""
    (envelopes.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false")
     .option("maxRecordsPerFile", rows_per_file).partitionBy("week_end").json(path))


def read_deliveries(spark, paths):
    """Envelopes with their file; the open-ended record and the unchecked integers stay VARIANT."""
    return (spark.read.schema(ENVELOPE).json(paths)
            .withColumn("file", F.col("_metadata.file_path"))
            .withColumn("position", F.monotonically_increasing_id()))


def verify_deliveries(files, envelopes, registry, max_rows=None, keep_all=False):
    """Violations of a delivery against its registry entry: checksum, row count, emptiness.

    ``files`` is ``(file, sha256)``, ``registry`` has ``file, sha256, rows``. Any row fails the run.
    """
    counted = envelopes.groupBy("file").agg(F.count("*").alias("found_rows"))
    joined = (registry.select("batch_id", "file", F.col("sha256").alias("expected"), "rows")
              .join(files.select("file", F.col("sha256").alias("actual")), "file", "left")
              .join(counted, "file", "left").na.fill({"found_rows": 0}))
    too_many = F.lit(False) if max_rows is None else F.col("found_rows") > max_rows
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(F.col("actual") != F.col("expected"), F.lit(True)), F.lit("checksum")),
        F.when(F.col("found_rows") != F.col("rows"), F.lit("row_count")),
        F.when((F.col("found_rows") == 0) | too_many, F.lit("size"))))
    judged = joined.withColumn("violations", reasons)
    return judged if keep_all else judged.filter(F.size("violations") > 0)


def admit(spark, landing, chosen, max_rows=None):
    """Rows of the chosen deliveries whose files pass, and the files that do not: ``(envelopes, refused)``.

    ``chosen`` has ``batch_id, key, sha256, rows, available_as_of``; ``key`` is a file under ``landing``. A file is refused as a whole, with all reasons: missing,
    checksum, row_count, size, envelope (no usable source, row or revision) or required_keys (a record lacks one). A file with another checksum is not
    opened as a delivery. ``rows`` may be null where it is not known. One row a file reaches the driver.
    """
    wanted = [(row["batch_id"], qualified(spark, f"{landing.rstrip('/')}/{row['key']}"), row["sha256"], row["rows"], row["available_as_of"])
              for row in chosen.select("batch_id", "key", "sha256", "rows", "available_as_of").collect()]
    entries = spark.createDataFrame(wanted, "batch_id string, file string, sha256 string, rows long, available_as_of string").withColumn("file", plain_path(F.col("file")))
    present = [row[1] for row in wanted if exists(spark, row[1])]
    prints = (file_fingerprints(spark, present).select(plain_path(F.col("file")).alias("file"), F.col("source_sha256").alias("sha256")) if present
              else spark.createDataFrame([], "file string, sha256 string"))
    prints = materialize(prints, "fingerprints")
    sound = [row["file"] for row in entries.join(prints, ["file", "sha256"], "left_semi").select("file").collect()]
    if sound:
        read = read_deliveries(spark, sound).withColumn("file", plain_path(F.col("file")))
        envelopes = materialize(read.select("file", *ENVELOPE.names, "position"), "landed")
    else:
        envelopes = spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), *ENVELOPE.fields, T.StructField("position", T.LongType())]))
    refused = file_violations(prints, envelopes, entries, max_rows)
    admitted = entries.join(refused.select("file"), "file", "left_anti").select("file", "batch_id", "available_as_of")
    return typed_envelopes(envelopes.join(admitted, "file")), refused


def typed_envelopes(rows):
    """Envelopes of admitted files with typed identity; the record stays VARIANT."""
    return rows.select("batch_id", "available_as_of", "position", "source_sha256", F.try_variant_get("source_row", "$", "bigint").alias("source_row"),
                       F.try_variant_get("revision", "$", "int").alias("revision"), "record")


def file_violations(files, envelopes, registry, max_rows=None):
    """``verify_deliveries`` plus what the rows of a file show: envelopes without identity, records without a required key."""
    present = F.lit(True)
    for name in REQUIRED:
        # A key with a JSON null is there; variant_get gives SQL null only for a key that is not.
        present = present & F.coalesce(F.variant_get("record", f"$.{name}", "variant").isNotNull(), F.lit(False))
    lacking = envelopes.groupBy("file").agg(F.count_if(~present).alias("lacking"))
    unidentified = envelope_violations(envelopes).groupBy("file").agg(F.count("*").alias("unidentified"))
    counted = (verify_deliveries(files, envelopes, registry, max_rows, keep_all=True).join(lacking, "file", "left").join(unidentified, "file", "left"))
    known = registry.join(files.select("file").distinct().withColumn("found", F.lit(True)), "file", "left").select("file", "found")
    unread = F.array_contains("violations", "checksum")
    extra = F.array_compact(F.array(F.when(F.col("unidentified") > 0, F.lit("envelope")), F.when(F.col("lacking") > 0, F.lit("required_keys"))))
    reasons = F.when(F.col("found").isNull(), F.array(F.lit("missing"))).when(unread, F.array(F.lit("checksum"))).otherwise(F.concat("violations", extra))
    return counted.join(known, "file").withColumn("violations", reasons).filter(F.size("violations") > 0).select("batch_id", "file", "violations")


def registry_violations(registry, schema_version=REGISTRY_VERSION):
    """Bad registry entries with all reasons. ``available_as_of`` must be zone-less source-local time."""
    repeated = (registry.groupBy("batch_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
                .select("batch_id", F.lit(True).alias("repeated")))
    local = F.coalesce(F.col("available_as_of").rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.lit(schema_version != REGISTRY_VERSION), F.lit("schema_version")),
        F.when(F.col("repeated"), F.lit("duplicate_id")),
        F.when(~is_sha256(F.col("sha256")), F.lit("checksum")),
        F.when(~F.coalesce(F.col("key").startswith(LANDING), F.lit(False)) | F.contains("key", F.lit("..")), F.lit("key")),
        F.when(~local, F.lit("availability"))))
    return (registry.join(repeated, "batch_id", "left").withColumn("violations", reasons).drop("repeated")
            .filter(F.size("violations") > 0))


def register(registry, arrivals):
    """Append new deliveries; an identical one is a no-op, a different one under a known id is a conflict.

    Returns ``(registry, conflicts, max_as_of)``.
    """
    known = registry.select("batch_id", F.col("sha256").alias("_sha"), F.col("available_as_of").alias("_at"))
    clash = arrivals.join(known, "batch_id").filter(
        (F.col("sha256") != F.col("_sha")) | (F.col("available_as_of") != F.col("_at"))).drop("_sha", "_at")
    grown = registry.unionByName(arrivals.join(known, "batch_id", "left_anti"))
    return grown, clash, grown.agg(F.max("available_as_of").alias("max_as_of"))


def changed_commitments(registry, processed):
    """Committed deliveries that vanished from the registry or changed; any row is an error."""
    known = registry.select("batch_id", F.col("sha256").alias("_now"))
    return (processed.join(known, "batch_id", "left")
            .filter(F.col("_now").isNull() | (F.col("_now") != F.col("sha256")))
            .select("batch_id", F.when(F.col("_now").isNull(), "removed").otherwise("changed").alias("problem")))


def select_batches(registry, processed, cutoff):
    """Unprocessed deliveries available at the cutoff, in arrival order."""
    return (registry.filter(F.col("available_as_of") <= F.lit(str(cutoff)))
            .join(processed.select("batch_id"), "batch_id", "left_anti").orderBy("available_as_of", "batch_id"))


def freshness(registry, processed, generated_at, now, max_as_of, stale_days=9):
    """One row: pending deliveries, days since publication and the stale flag."""
    pending = registry.filter(F.col("available_as_of") <= F.lit(str(max_as_of))).join(
        processed.select("batch_id"), "batch_id", "left_anti").agg(F.count("*").alias("pending_batches"))
    age = F.lit(999.0) if generated_at is None else F.timestamp_diff(
        "SECOND", F.lit(str(generated_at)).cast("timestamp_ntz"), F.lit(str(now)).cast("timestamp_ntz")) / F.lit(86400.0)
    return pending.withColumn("days_since_publication", age).withColumn(
        "stale", (F.col("pending_batches") > 0) & (F.col("days_since_publication") > stale_days))
