"""One incremental run: select deliveries, admit their files, merge, maintain the incident tables, check, publish."""
import json
from datetime import datetime, timezone

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.text import content_hash
from tideline.operators import history as hist
from tideline.operators import merge, normalize, parts, reports, star
from tideline.session import materialize
from tideline.sources import deliveries as batches
from tideline.sources import publish

DELIVERY = ("revision", "content_hash", "batch_id", "available_as_of", "position")
#: Columns of the snapshot that follow from the cutoff and are not kept.
OF_CUTOFF = ("age_hours", "snapshot_date_key")


def normalized_deliveries(envelopes):
    """Envelopes with a ``record`` (struct or VARIANT) to checked rows carrying their delivery identity, payload hash and the record as it came."""
    kept = ["batch_id", "available_as_of", "position", "revision", "source_sha256", "source_row", content_hash(F.col("record")).alias("content_hash"), "record"]
    if dict(envelopes.dtypes)["record"] == "variant":
        fields = [F.try_variant_get("record", f"$.{name}", "string").alias(name) for name in (*normalize.REQUIRED, *normalize.OPTIONAL)]
    else:
        fields = [F.col(f"record.{name}").alias(name) for name in envelopes.schema["record"].dataType.names]
    return normalize.validate_rows(envelopes.select(*kept, *fields))


def touched_parts(changes, manifest, previous_as_of):
    """Parts that an increment changes: those of changed events, and those with events that the previous cutoff still hid."""
    changed = changes.select("part").distinct()
    if manifest is None:
        return changed
    hidden = manifest.filter((F.col("name") == "events") & (F.col("latest") > F.lit(previous_as_of).cast("timestamp_ntz")))
    return changed.unionByName(hidden.select(F.col("part").cast("bigint").alias("part"))).distinct()


def maintain(spark, root, attempt, changes, as_of, previous, width):
    """Write the changed parts of every incident table; returns the manifest rows of all parts.

    Only incidents with changed or newly visible events are computed anew, from their events; the other incidents of a touched part are copied over,
    and other parts keep their slots.
    """
    manifest = publish.read_manifest(spark, root, previous) if previous is not None else None
    touched = materialize(touched_parts(changes, manifest, previous["as_of"] if previous is not None else None), "parts")

    def before(name):
        """Rows of the touched parts as they were, or None."""
        if manifest is None:
            return None
        slots = manifest.filter(F.col("name") == name).join(touched.select(F.col("part").cast("string").alias("part")), "part", "left_semi")
        return None if slots.isEmpty() else parts.with_part(publish.live_slots(spark, root, slots, name).drop("part"), width)

    def now(name):
        """Rows of the touched parts as this attempt wrote them."""
        slots = touched.select(publish.slot_name(F.col("part"), attempt).alias("slot"))
        return publish.live_slots(spark, root, slots, name)

    old = before("events")
    grown = changes if old is None else old.join(changes.select("event_id"), "event_id", "left_anti").unionByName(changes, allowMissingColumns=True)
    publish.write_parts(grown, root, attempt, "events")
    events = now("events")
    incidents = changes.select("incident_id")
    if previous is not None:
        newly = events.filter(F.col("updated_at") > F.lit(previous["as_of"]).cast("timestamp_ntz")).select("incident_id")
        incidents = incidents.unionByName(newly)
    incidents = materialize(incidents.distinct(), "incidents")
    todo = events.join(incidents, "incident_id", "left_semi")

    def write(name, computed):
        kept = before(name)
        whole = computed if kept is None else computed.unionByName(kept.join(incidents, "incident_id", "left_anti"), allowMissingColumns=True)
        publish.write_parts(whole, root, attempt, name)

    write("segments", parts.with_part(hist.segment_summary(todo, as_of), width))
    segments = now("segments")
    state = hist.snapshot_keys(hist.incident_snapshot(segments.join(incidents, "incident_id", "left_semi"), as_of), as_of).drop(*OF_CUTOFF)
    write("incident_state", parts.with_part(state, width))
    write("fact_incident_history", parts.with_part(hist.incident_history(todo, as_of), width))
    publish.write_parts(parts.members(events, as_of), root, attempt, "part_members")
    publish.write_parts(hist.daily_flows(segments, keys=("part",)), root, attempt, "part_flows")
    publish.write_parts(parts.profile_parts(events), root, attempt, "part_profile")
    latest = events.groupBy("part").agg(F.max("updated_at").alias("latest"))
    fresh = (touched.join(latest, "part", "left").crossJoin(spark.createDataFrame([(name,) for name in publish.BY_PART], "name string"))
             .select("name", F.col("part").cast("string").alias("part"), publish.slot_name(F.col("part"), attempt).alias("slot"), "latest"))
    if manifest is None:
        return fresh, now
    carried = manifest.filter(F.col("name").isin(*publish.BY_PART)).join(touched.select(F.col("part").cast("string").alias("part")), "part", "left_anti")
    return carried.select(*fresh.columns).unionByName(fresh), now


def run(spark, root, registry, envelopes, as_of, dataset_sha256, code_version="1", max_reject_rate=0.01,
        generated_at=None, width=parts.WIDTH):
    """Publish cutoff ``as_of`` from the deliveries available at it; a repeated run is a no-op.

    ``envelopes``: rows ``batch_id, available_as_of, position, source_sha256, source_row, revision, record``, or a function that takes the chosen
    registry entries and returns such rows and the entries it refused (``batch_id, file, violations``). Refused deliveries are published as a table and
    stay unprocessed. ``width`` is the range of incident numbers of a part and must not change between runs.
    """
    generated_at = generated_at or datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ", timespec="seconds")
    if not batches.registry_violations(registry).isEmpty():
        raise ValueError("The registry has bad entries")
    after = publish.latest_sequence(spark, root)
    previous = publish.read_pointer(spark, root, after)
    publish.check_succession(previous, as_of, dataset_sha256)
    available = registry.filter(F.col("available_as_of") <= F.lit(str(as_of)))
    run_id = publish.run_identity(available, as_of, code_version)
    if previous is not None and previous["run_id"] == run_id:
        return previous
    processed = (publish.published_table(spark, root, "processed", previous).select("batch_id", "sha256") if previous is not None
                 else registry.select("batch_id", "sha256").limit(0))
    if not batches.changed_commitments(registry, processed).isEmpty():
        raise ValueError("A published delivery is missing from the registry or differs from it")
    chosen = materialize(batches.select_batches(registry, processed, as_of), "chosen")
    refused = spark.createDataFrame([], "batch_id string, file string, violations array<string>")
    if callable(envelopes):
        envelopes, refused = envelopes(chosen)
        refused = materialize(refused, "refused")
        chosen = chosen.join(refused.select("batch_id"), "batch_id", "left_anti")
    new = envelopes.join(chosen.select("batch_id"), "batch_id", "left_semi")
    if not normalize.envelope_violations(new).isEmpty():
        raise ValueError("An envelope has no usable source, row or revision")
    checked = materialize(normalized_deliveries(new), "checked")
    incoming = materialize(normalize.accepted(checked, extra=DELIVERY), "incoming")
    old = merge.affected(publish.published_table(spark, root, "event_revisions", previous), incoming) if previous is not None else None
    narrow = merge.narrow_versions(old, incoming)
    merge.require_consistent_versions(narrow)
    attempt = publish.new_attempt(run_id)
    versions = materialize(merge.outcomes(narrow), "outcomes")
    added = merge.new_versions(incoming.withColumn("received_at", F.lit(generated_at)), narrow, versions, previous["as_of"] if previous is not None else None, sliced=True)
    publish.write_whole(added, root, attempt, "event_revisions", within=("source_bucket",))
    slot = spark.createDataFrame([(f"{publish.WHOLE}-{attempt}",)], "slot string")
    this = lambda name: publish.live_slots(spark, root, slot, name, one=True)
    written = this("event_revisions") if not versions.filter("outcome <> 'kept'").isEmpty() else added.drop("source_bucket").limit(0)
    stats = materialize(merge.merge_stats(merge.outcome_counts(versions, written), checked), "statistics")
    changes = materialize(parts.with_part(merge.current_changes(written.drop("source_bucket")), width), "changes")
    by_part, now = maintain(spark, root, attempt, changes, as_of, previous, width)
    by_part = materialize(by_part, "manifest")

    def everywhere(name):
        return publish.live_slots(spark, root, by_part.filter(F.col("name") == name), name)

    all_members = materialize(everywhere("part_members"), "members")
    gate = normalize.quality_gate(stats.select("reject_rate").crossJoin(everywhere("events").agg(F.count("*").alias("events"))), max_reject_rate)
    row = normalize.enforce(gate, "Quality gate failed")
    if all_members.isEmpty():
        raise ValueError("No event is visible at the cutoff")
    workflow = reports.workflow_state(registry, processed, as_of, previous["as_of"] if previous is not None else None,
                                      registry.agg(F.max("available_as_of")).first()[0])
    whole = {"dim_assignment_group": parts.dim_assignment_group(all_members), "dim_priority": parts.dim_priority(all_members), "dim_date": parts.dim_date(all_members, as_of)}
    for name, table in whole.items():
        publish.write_whole(table, root, attempt, name)
    dims = [this(name) for name in whole]
    stage = publish.with_cutoff(now("incident_state"), as_of)
    touched_fact = star.fact_snapshot(stage, *dims)
    normalize.enforce(star.join_grain(stage, touched_fact), "The dimensions lost or doubled incidents")
    fact = publish.with_cutoff(everywhere("incident_state"), as_of)
    seen = all_members.agg(F.sum("events").alias("events"))
    whole = {"fact_daily_queue": hist.queue_of_flows(parts.total_flows(everywhere("part_flows")), as_of), "aggregate_queue": star.aggregate_queue(fact, *dims[:2]),
             "report_summary": reports.summary(None, fact, as_of, seen), "report_groups": reports.group_priority(fact),
             "report_profile": parts.profile(everywhere("part_profile")), "workflow": workflow}
    for name, table in whole.items():
        publish.write_whole(table, root, attempt, name)
    appended = {"quarantine": normalize.quarantined(checked, extra=("batch_id", "revision", "record")), "processed": chosen.select("batch_id", "sha256"),
                "refused_files": refused, "run_statistics": stats.withColumn("as_of", F.lit(str(as_of))),
                "reject_reasons": normalize.reject_reasons(checked).withColumn("as_of", F.lit(str(as_of)))}
    for name, table in appended.items():
        publish.write_whole(table, root, attempt, name)
    groups = this("report_groups")
    checks = materialize(star.integrity_checks(now("events"), touched_fact, now("fact_incident_history"), *dims, this("report_summary"), groups, this("fact_daily_queue"), as_of),
                         "checks")
    plain = groups.select(F.col("group").alias("group_name"), "priority", "incidents", F.col("open").alias("open_count"), "reopened", "reassigned")
    normalize.enforce(reports.reconcile(this("aggregate_queue"), plain), "Queue aggregates differ from the report")
    _write_manifest(spark, root, attempt, by_part, ["dim_assignment_group", "dim_priority", "dim_date", *whole], previous)
    before = json.loads(previous["quality"]) if previous is not None else {"source_rows": 0, "rejected_rows": 0}
    totals = stats.select("input_rows", "rejected_rows").first()
    source_rows = before["source_rows"] + totals["input_rows"]
    rejected_rows = before["rejected_rows"] + totals["rejected_rows"]
    quality = {"source_rows": source_rows, "rejected_rows": rejected_rows, "accepted_rows": source_rows - rejected_rows,
               "reject_rate": rejected_rows / max(1, source_rows), "current_events": row["events"]}
    return publish.commit(spark, root, attempt, run_id, as_of, dataset_sha256, quality, generated_at, gate, checks, after)


def _write_manifest(spark, root, attempt, by_part, whole, previous):
    """Live slots after this attempt: the parts, this attempt's whole tables, and all slots of append-only tables."""
    slot = f"{publish.WHOLE}-{attempt}"
    mine = spark.createDataFrame([(name, publish.WHOLE, slot, None) for name in (*whole, *publish.APPEND_ONLY)], publish.MANIFEST)
    rows = by_part.select("name", "part", "slot", "latest").unionByName(mine)
    if previous is not None:
        rows = rows.unionByName(publish.read_manifest(spark, root, previous).filter(F.col("name").isin(*publish.APPEND_ONLY)))
    publish.write_manifest(rows, root, attempt)


def run_landed(spark, root, landing, registry, as_of, dataset_sha256, **options):
    """``run`` over the files that the registry names under ``landing``: each is admitted or refused as a whole before anything is merged."""
    return run(spark, root, registry, lambda chosen: batches.admit(spark, landing, chosen), as_of, dataset_sha256, **options)
