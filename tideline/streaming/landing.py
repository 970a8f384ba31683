"""Landing-directory intake: every new delivery file is admitted or refused as a whole and merged once, late rows included.

No watermark: a late row is kept and restates history. Restarting from the checkpoint replays at most the last
micro-batch, whose version folders are then overwritten with the same content.
"""
from pyspark.sql import functions as F

from tideline.operators import merge
from tideline.operators.normalize import accepted, envelope_violations, quarantined
from tideline.plans.incremental import DELIVERY, normalized_deliveries
from tideline.session import exists, materialize, qualified
from tideline.sources import deliveries
from tideline.sources.audit_csv import file_fingerprints, plain_path


def stored_history(spark, path, before):
    """Versions committed by earlier micro-batches, or None."""
    if not exists(spark, path):
        return None
    return spark.read.parquet(path).filter(F.col("micro_batch") < before).drop("micro_batch")


def _store(table, batch_id, path):
    within = [name for name in table.columns if name == "source_bucket"]
    (table.withColumn("micro_batch", F.lit(batch_id)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("micro_batch", *within).parquet(path))


def admitted(frame, landing, registry):
    """Rows of a micro-batch whose files the registry vouches for, and ``(batch_id, file, violations)`` of the others.

    ``registry`` has ``batch_id, key, sha256, rows, available_as_of``. A file that no entry names is refused as ``unregistered``. Fingerprints are taken of the
    micro-batch's files only (their names, one a file, reach the driver; ``maxFilesPerTrigger`` bounds them).
    """
    spark = frame.sparkSession
    rows = materialize(frame.withColumn("file", plain_path(F.col("file"))).withColumn("position", F.monotonically_increasing_id()), "landed")
    names = [row["file"] for row in rows.select("file").distinct().collect()]
    root = qualified(spark, landing.rstrip("/"))
    entries = registry.withColumn("file", plain_path(F.concat(F.lit(f"{root}/"), "key"))).filter(F.col("file").isin(names))
    entries = materialize(entries.select("batch_id", "file", "sha256", F.col("rows").cast("long").alias("rows"), "available_as_of"), "entries")
    prints = materialize(file_fingerprints(spark, names).select(plain_path(F.col("file")).alias("file"), F.col("source_sha256").alias("sha256")), "fingerprints")
    refused = deliveries.file_violations(prints, rows, entries)
    unnamed = prints.join(entries.select("file"), "file", "left_anti").select(
        F.lit(None).cast("string").alias("batch_id"), "file", F.array(F.lit("unregistered")).alias("violations"))
    refused = materialize(refused.unionByName(unnamed), "refused")
    sound = entries.join(refused.select("file"), "file", "left_anti").select("file", "batch_id", "available_as_of")
    return deliveries.typed_envelopes(rows.join(sound, "file")), refused


def merge_micro_batch(path, previous_as_of=None, quarantine_path=None, landing=None, registry=None, refused_path=None):
    """``foreachBatch`` body: admit files (where a registry is given), classify the batch against the history it touches, store its new versions only."""
    def body(frame, batch_id):
        if frame.isEmpty():
            return
        if registry is not None:
            entries = registry() if callable(registry) else registry
            frame, refused = admitted(frame, landing, entries)
            if refused_path:
                _store(refused, batch_id, refused_path)
        if not envelope_violations(frame).isEmpty():
            raise ValueError("An envelope has no usable source, row or revision")
        checked = materialize(normalized_deliveries(frame), "checked")
        incoming = materialize(accepted(checked, extra=DELIVERY), "incoming")
        narrow, versions = merge.classify(merge.affected(stored_history(frame.sparkSession, path, batch_id), incoming), incoming)
        merge.require_consistent_versions(narrow)
        _store(merge.new_versions(incoming, narrow, versions, previous_as_of, sliced=True).drop("outcome"), batch_id, path)
        if quarantine_path:
            _store(quarantined(checked, extra=("batch_id", "revision", "record")), batch_id, quarantine_path)
    return body


def watch_landing(spark, landing, schema, history_path, checkpoint, previous_as_of=None, quarantine_path=None, registry=None, refused_path=None, files_per_batch=1000):
    """Process everything that has landed, then stop. ``schema`` describes one delivery line.

    With a ``registry`` (a table, or a function that reads it anew for each micro-batch) lines are envelopes of ``deliveries.ENVELOPE`` and files pass its gate first.
    """
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).json(landing)
    if registry is not None:
        stream = stream.withColumn("file", F.col("_metadata.file_path"))
    body = merge_micro_batch(history_path, previous_as_of, quarantine_path, landing, registry, refused_path)
    return stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
