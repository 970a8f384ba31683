"""Merging revisioned, duplicated and late deliveries into a version history, as set operations.

A version is ``(event_id, revision)``; the first delivery of it counts. Arrival order is ``(available_as_of, batch_id, position)``, with everything
already in the history before any new delivery; ``(batch_id, position)`` names one delivery.

Outcomes are found on narrow rows: 128 bits of hash for the event, a number for the batch, the position and 64-bit hashes, all of fixed width, so every
aggregate is a hash aggregate. Payload is exchanged only where a bit set over narrow keys says that a row may be one of several: deliveries of one version,
versions of one event. All other rows stay where they are read. An event comes from one source file, so history partitioned by slices of source files is
read only where the increment has sources, and only its rows that may share an event with the increment take part.
"""
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.timecols import ntz
from tideline.operators.sieve import Sieve, without
from tideline.session import materialize

ARRIVAL = ("available_as_of", "batch_id", "position")
SOURCE = "source_sha256"
BLOCK = 65_536
#: An event by its hashes.
EVENT = ("event_id_a", "event_id_b")
#: Slices of a history by source file; a file's versions lie in one of them.
SOURCE_BUCKETS = 1024


class Merge(NamedTuple):
    versions: DataFrame
    new: DataFrame
    history: DataFrame
    current: DataFrame
    counts: DataFrame


def _prints(column):
    """Two 64-bit hashes: equal for equal values, and fixed in width unlike the value."""
    return F.xxhash64(column), F.xxhash64(F.lit("2"), column)


def _unlike(name):
    return (F.min(f"{name}_a") != F.max(f"{name}_a")) | (F.min(f"{name}_b") != F.max(f"{name}_b"))


def _with_prints(rows, name):
    a, b = _prints(F.col(name))
    return rows.withColumns({f"{name}_a": a, f"{name}_b": b})


def _packed(rows):
    """Event names that are hexadecimal digits, as hashes are, in half their length for an exchange; other names as they are."""
    digits = F.coalesce(F.col("event_id").rlike("^([0-9a-f]{2})+$"), F.lit(False))
    return rows.withColumns({"event_bytes": F.when(digits, F.unhex("event_id")), "event_text": F.when(~digits, F.col("event_id"))}).drop("event_id")


def _unpacked(rows):
    return rows.withColumn("event_id", F.coalesce(F.lower(F.hex("event_bytes")), "event_text")).drop("event_bytes", "event_text")


def _exchanged(rows, join):
    return _unpacked(join(_packed(rows)))


def conflicts(history, incoming):
    """Versions delivered with more than one payload; any row refuses the run."""
    both = _with_prints(_both(history, incoming, "event_id", "revision", "content_hash"), "content_hash")
    return (both.groupBy("event_id", "revision").agg(F.count("*").alias("deliveries"), _unlike("content_hash").alias("unlike"))
            .filter("unlike").select("event_id", "revision", "deliveries"))


def identity_violations(history, incoming):
    """Events whose accepted versions name more than one incident; any row refuses the run. Names are fetched for these events only."""
    both = _both(history, incoming, "event_id", "incident_id")
    bad = (_with_prints(both, "incident_id").groupBy("event_id").agg(_unlike("incident_id").alias("unlike")).filter("unlike").select("event_id"))
    return both.join(bad, "event_id", "left_semi").groupBy("event_id").agg(F.min("incident_id").alias("low"), F.max("incident_id").alias("high"))


def require_consistent(history, incoming):
    if not conflicts(history, incoming).isEmpty():
        raise ValueError("One revision of an event was delivered with two payloads")
    if not identity_violations(history, incoming).isEmpty():
        raise ValueError("Versions of one event name two incidents")


def _both(history, incoming, *names):
    new = incoming.select(*names)
    return new if history is None else history.select(*names).unionByName(new)


def source_bucket(source):
    """Slice of the history in which all versions of a source file's events lie."""
    return F.pmod(F.xxhash64(source), F.lit(SOURCE_BUCKETS)).cast("int")


def affected(history, incoming):
    """The part of the history that an increment can touch, and few other rows; the rest takes no part in the merge.

    A history partitioned by ``source_bucket`` is pruned at run time: the increment's buckets (at most ``SOURCE_BUCKETS`` numbers) are broadcast to the scan.
    Any history is then reduced by a bit set over the increment's events.
    """
    if history is None:
        return None
    if "source_bucket" in history.columns:
        named = incoming.select(source_bucket(F.col(SOURCE)).alias("source_bucket")).distinct().filter("source_bucket >= 0")
        history = history.join(F.broadcast(named), "source_bucket", "left_semi")
    near, _ = Sieve(incoming.select("event_id"), ["event_id"]).split(history)
    return near


class Narrow(NamedTuple):
    """Versions of an increment and the history it can touch, without payload (stored), and the increment's batches in arrival order (stored)."""
    versions: DataFrame
    batches: DataFrame


def _numbered(incoming, batches):
    return incoming.join(batches, ["available_as_of", "batch_id"])


def narrow_versions(history, incoming):
    """One narrow row per version: hashes of the event, ``revision, batch_no, position, deliveries`` and hashes of payload and incident. ``batch_no`` 0 is the history."""
    order = Window.orderBy("available_as_of", "batch_id")
    batches = materialize(incoming.select("available_as_of", "batch_id").distinct().withColumn("batch_no", F.row_number().over(order)), "batches")
    names = [*EVENT, "revision", "batch_no", "position"]
    checked = [name for name in ("content_hash", "incident_id") if name in incoming.columns]

    def narrow(rows):
        for name in ("event_id", *checked):
            rows = _with_prints(rows, name)
        return rows.select(*names, *[f"{name}_{x}" for name in checked for x in "ab"])

    rows = narrow(_numbered(incoming, batches))
    if history is not None:
        rows = rows.unionByName(narrow(history.withColumns({"batch_no": F.lit(0), "position": F.lit(None).cast("long")})))
    spans = lambda source: {f"{end}_{name}_{x}": fn(f"{'' if source else f'{end}_'}{name}_{x}") for name in checked for x in "ab"
                            for end, fn in (("low", F.min), ("high", F.max))}
    named = lambda measures: [measure.alias(name) for name, measure in measures.items()]
    # One exchange serves both steps: the earliest position in a batch, then the earliest batch.
    by_batch = rows.repartition(*EVENT, "revision").groupBy(*EVENT, "revision", "batch_no").agg(
        F.min("position").alias("position"), F.count_if(F.col("batch_no") > 0).alias("copies"), *named(spans(True)))
    versions = by_batch.groupBy(*EVENT, "revision").agg(
        F.min("batch_no").alias("batch_no"), F.min_by("position", "batch_no").alias("position"), F.sum("copies").alias("deliveries"), *named(spans(False)))
    return Narrow(materialize(versions, "versions", compact=True), batches)


def require_consistent_versions(narrow):
    """``require_consistent`` over rows that ``narrow_versions`` has stored."""
    apart = lambda name: " OR ".join(f"low_{name}_{x} <> high_{name}_{x}" for x in "ab")
    if not narrow.versions.filter(apart("content_hash")).isEmpty():
        raise ValueError("One revision of an event was delivered with two payloads")
    spans = narrow.versions.groupBy(*EVENT).agg(*[fn(f"{end}_incident_id_{x}").alias(f"{end}_incident_id_{x}") for x in "ab" for end, fn in (("low", F.min), ("high", F.max))])
    if not spans.filter(apart("incident_id")).isEmpty():
        raise ValueError("Versions of one event name two incidents")


def outcomes(narrow, block=BLOCK):
    """One row per version among the touched events: hashes of the event, ``revision, batch_no, position, outcome, duplicates``.

    ``outcome`` is ``kept`` for versions of the history that arrive again or share an event with new ones, else inserted, corrected or stale. It follows
    from the highest revision before a version, a running maximum along an event's arrivals. Events with more than ``block`` versions are cut into
    blocks of arrivals: the maximum then runs inside blocks and over one row a block, so such an event is not one task's work.
    """
    versions = narrow.versions.select(*EVENT, "revision", "batch_no", "position", "deliveries")
    large = versions.groupBy(*EVENT).agg(F.count("*").alias("n"), F.sum("deliveries").alias("all_arrived")).filter(F.col("n") > block).drop("n")
    large = materialize(large, "large", compact=True)
    is_large = F.col("all_arrived").isNotNull()
    rows = versions.join(large, [*EVENT], "left").withColumns({
        "batch": F.when(is_large, F.col("batch_no")).otherwise(0), "chunk": F.when(is_large & (F.col("batch_no") > 0), F.floor(F.col("position") / block)).otherwise(0)})
    inside = Window.partitionBy(*EVENT, "batch", "chunk")
    rows = rows.withColumn("inner_peak", F.max("revision").over(inside.orderBy("batch_no", "position", "revision").rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("arrived", F.coalesce("all_arrived", F.sum("deliveries").over(inside))).filter("arrived > 0")
    across = Window.partitionBy(*EVENT).orderBy("batch", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    peaks = (versions.join(large, [*EVENT]).groupBy(*EVENT, F.col("batch_no").alias("batch"), F.when(F.col("batch_no") > 0, F.floor(F.col("position") / block)).otherwise(0).alias("chunk"))
             .agg(F.max("revision").alias("peak")).withColumn("earlier_peak", F.max("peak").over(across)).drop("peak"))
    placed = rows.join(peaks, [*EVENT, "batch", "chunk"], "left")
    prior = F.greatest("inner_peak", "earlier_peak")
    outcome = F.when(F.col("batch_no") == 0, "kept").when(prior.isNull(), "inserted").when(F.col("revision") > prior, "corrected").otherwise("stale")
    return placed.select(*EVENT, "revision", "batch_no", "position", outcome.alias("outcome"), (F.col("deliveries") - (F.col("batch_no") > 0).cast("int")).alias("duplicates"))


def classify(history, incoming, block=BLOCK):
    """Narrow rows and outcomes of an increment, both stored: ``(Narrow, outcomes)``."""
    narrow = narrow_versions(history, incoming)
    return narrow, materialize(outcomes(narrow, block), "outcomes", compact=True)


def new_versions(incoming, narrow, versions, previous_as_of=None, graded=True, sliced=False):
    """The versions that this run adds, with their payload, outcome (unless not ``graded``) and ``late_arrival``; ``sliced``: also ``source_bucket``.

    A version delivered once that is inserted needs no lookup: its row is taken where it is read. Rows that a bit set over all other versions lets through
    are exchanged to meet their version. Without grades, that is left to versions delivered more than once. ``versions`` is read several times: store it.
    """
    late = F.lit(False) if previous_as_of is None else F.col("updated_at") <= ntz(previous_as_of)
    known = [*EVENT, "revision", "batch_no", "position"]
    looked_up = versions.filter("duplicates > 0 OR outcome = 'kept'" + (" OR outcome <> 'inserted'" if graded else ""))
    sieve = Sieve(looked_up, [*EVENT, "revision"])
    rows = _with_prints(_numbered(incoming, narrow.batches).filter("event_id IS NOT NULL AND revision IS NOT NULL AND position IS NOT NULL"), "event_id")
    if sliced:
        rows = rows.withColumn("source_bucket", source_bucket(F.col(SOURCE)))
    several, single = sieve.split(rows)
    chosen, _ = sieve.split(versions.filter("outcome <> 'kept'").select(*known, "outcome"))
    met = _exchanged(several, lambda rows: rows.join(chosen, known))
    if sliced:
        met = met.hint("rebalance", "source_bucket")  # the writer then makes few files of them
    found = met.unionByName(single.withColumn("outcome", F.lit("inserted")))
    return (found if graded else found.drop("outcome")).drop(*EVENT, "batch_no").withColumn("late_arrival", late)


def merge_deliveries(history, incoming, previous_as_of=None, received_at=None, block=BLOCK):
    """Versions of the touched events, the new ones with payload, the grown (append-only) history, current events and outcome counts."""
    stamped = incoming.withColumn("received_at", F.lit(received_at).cast("string"))
    if "received_at" in incoming.columns and received_at is None:
        stamped = incoming
    touched = affected(history, stamped)
    narrow, versions = classify(touched, stamped, block)
    new = new_versions(stamped, narrow, versions, previous_as_of)
    added = new.drop("outcome")
    grown = added if history is None else history.unionByName(added, allowMissingColumns=True)
    names = _with_prints(_both(touched, stamped, "event_id").distinct(), "event_id")
    return Merge(names.join(versions, [*EVENT]).drop(*EVENT), new, grown, current_events(grown), outcome_counts(versions, new))


def current_changes(new):
    """New current rows of an increment: per event the highest of its versions that rose above all before them. Stale versions change nothing."""
    risen = new.filter(F.col("outcome").isin("inserted", "corrected"))
    return current_events(risen.drop("outcome"))


def refreshed_current(current, new):
    """Current events after an increment: changed ones from the new versions, the others as they were.

    Events that were only inserted are new to the history, so rows of corrected ones alone can be replaced.
    """
    changes = current_changes(new)
    if current is None:
        return changes
    corrected = materialize(_with_prints(new.filter("outcome = 'corrected'"), "event_id").select(*EVENT).distinct(), "corrected", compact=True)
    others = without(_with_prints(current, "event_id"), corrected, EVENT, _exchanged).drop(*EVENT)
    return others.unionByName(changes, allowMissingColumns=True)


def current_events(history):
    """Highest revision of each event: a hash aggregate over narrow rows names the lower versions, and the rows of all others are taken where they are read."""
    rows = _with_prints(history, "event_id").filter("event_id IS NOT NULL AND revision IS NOT NULL")
    narrow = rows.select(*EVENT, "revision")
    tops = narrow.groupBy(*EVENT).agg(F.max("revision").alias("top"), F.min("revision").alias("low")).filter("low < top").drop("low")
    tops = materialize(tops, "tops", compact=True)
    shared, _ = Sieve(tops, EVENT).split(narrow)
    lower = materialize(shared.join(tops, [*EVENT]).filter("revision < top").drop("top"), "lower", compact=True)
    return without(rows, lower, [*EVENT, "revision"], _exchanged).drop(*EVENT)


def with_duplicates(rows, versions):
    """``rows`` of versions with the number of duplicates that this run brought of each; only rows that may have some are exchanged."""
    again = materialize(versions.filter("duplicates > 0").select(*EVENT, "revision", "duplicates"), "again", compact=True)
    several, single = Sieve(again, [*EVENT, "revision"]).split(_with_prints(rows, "event_id"))
    several = _exchanged(several, lambda rows: rows.join(again, [*EVENT, "revision"], "left")).withColumn("duplicates", F.coalesce("duplicates", F.lit(0)))
    return single.withColumn("duplicates", F.lit(0).cast("long")).unionByName(several).drop(*EVENT)


def outcome_counts(versions, new):
    """One row: inserted, corrected, stale, duplicate and late counts of this run's accepted deliveries."""
    graded = versions.agg(F.count_if(F.col("outcome") == "inserted").alias("inserted"), F.count_if(F.col("outcome") == "corrected").alias("corrected"),
                          F.coalesce(F.sum("duplicates"), F.lit(0)).alias("duplicates"), F.count_if(F.col("outcome") == "stale").alias("stale_revisions"))
    late = new.agg(F.count_if(F.col("outcome").isin("inserted", "corrected") & F.col("late_arrival")).alias("late_arrivals"))
    return graded.crossJoin(late)


def merge_stats(counts, checked):
    """Full statistics row: row counts of the run's normalized input joined to its outcome counts."""
    bad = F.count_if(F.size("errors") > 0)
    read = checked.agg(F.count("*").alias("input_rows"), (F.count("*") - bad).alias("valid_rows"), bad.alias("rejected_rows"))
    return (read.crossJoin(counts)
            .withColumn("reject_rate", F.col("rejected_rows") / F.greatest(F.col("input_rows"), F.lit(1)))
            .withColumn("events", F.col("valid_rows")))
