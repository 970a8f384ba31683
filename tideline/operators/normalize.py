"""Raw audit rows to validated events, keeping every reason a row was refused."""
from pyspark.sql import functions as F

from tideline.functions.text import UNKNOWN, clean_text, event_key, is_sha256, strip
from tideline.functions.timecols import parse_day_first

# Workflow states, terminal states, required source columns, event fields.
STATES = ("New", "Active", "Awaiting User Info", "Awaiting Vendor", "Awaiting Problem", "Awaiting Evidence",
          "Resolved", "Closed")
TERMINAL = ("Resolved", "Closed")
REQUIRED = ("number", "incident_state", "opened_at", "sys_updated_at", "sys_mod_count", "priority",
            "assignment_group", "reopen_count", "reassignment_count")
OPTIONAL = ("category", "contact_type")
DATES = ("opened_at", "sys_updated_at")
COUNTERS = ("sys_mod_count", "reopen_count", "reassignment_count")
EVENT_FIELDS = ("event_id", "source_sha256", "source_row", "incident_id", "state", "opened_at", "updated_at",
                "event_date", "sys_mod_count", "priority", "assignment_group", "category", "contact_type",
                "reopen_count", "reassignment_count")
DIMENSIONS = ("priority", "assignment_group", "category", "contact_type")


def is_terminal(column):
    return column.isin(*TERMINAL)


def validate_headers(columns):
    missing = sorted(set(REQUIRED) - set(columns))
    if missing:
        raise ValueError(f"The header lacks required names: {', '.join(missing)}")


def _counter(name):
    """Non-negative integer text as BIGINT, else null."""
    text = F.col(f"_text_{name}")
    return F.when(text.rlike(r"^\d+$"), text).try_cast("bigint")


def _date_error(name, parsed):
    text = F.col(f"_text_{name}")
    return F.when(text.isNull() | text.isin("", "?"), F.lit(f"missing_{name}")).when(parsed.isNull(), F.lit(f"invalid_{name}"))


def validate_rows(raw):
    """Add parsed columns and ``errors`` (all reasons, in a fixed order) to raw string rows.

    ``raw`` needs the required columns plus ``source_sha256`` and ``source_row``; others pass through.
    """
    validate_headers(raw.columns)
    for name in OPTIONAL:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    texts = raw.select("*", *[strip(F.col(name)).alias(f"_text_{name}") for name in (*DATES, *COUNTERS)],
                       clean_text(F.col("number")).alias("_incident"), clean_text(F.col("incident_state")).alias("_state"))
    parsed = texts.select("*", *[parse_day_first(F.col(f"_text_{name}"), stripped=True).alias(f"_{name}") for name in DATES],
                          *[_counter(name).alias(f"_{name}") for name in COUNTERS])
    reasons = [
        F.when(F.col("_incident") == UNKNOWN, F.lit("missing_incident_id"))
        .when(~F.col("_incident").rlike(r"^INC\d+$"), F.lit("invalid_incident_id")),
        F.when(~F.col("_state").isin(*STATES), F.lit("unknown_state")),
        *[_date_error(name, F.col(f"_{name}")) for name in DATES],
        F.when(F.col("_sys_updated_at") < F.col("_opened_at"), F.lit("update_before_open")),
    ]
    for name in COUNTERS:
        bad = F.col(f"_{name}").isNull()
        reasons.append(F.when(bad & F.col(f"_text_{name}").startswith("-"), F.lit(f"negative_{name}")))
        reasons.append(F.when(bad, F.lit(f"invalid_{name}")))
    return parsed.withColumn("errors", F.array_compact(F.array(*reasons))).drop(
        *[f"_text_{name}" for name in (*DATES, *COUNTERS)])


def project_event(checked, extra=()):
    """The fifteen event fields. Outcome columns of the source are dropped here so they cannot leak."""
    return checked.select(
        event_key(F.col("source_sha256"), F.col("source_row")).alias("event_id"), "source_sha256", "source_row",
        F.col("_incident").alias("incident_id"), F.col("_state").alias("state"),
        F.col("_opened_at").alias("opened_at"), F.col("_sys_updated_at").alias("updated_at"),
        F.to_date("_sys_updated_at").alias("event_date"), F.col("_sys_mod_count").alias("sys_mod_count"),
        *[clean_text(F.col(name)).alias(name) for name in DIMENSIONS],
        F.col("_reopen_count").alias("reopen_count"), F.col("_reassignment_count").alias("reassignment_count"), *extra)


def accepted(checked, extra=()):
    return project_event(checked.filter(F.size("errors") == 0), extra)


def quarantined(checked, extra=()):
    return checked.filter(F.size("errors") > 0).select(
        event_key(F.col("source_sha256"), F.col("source_row")).alias("event_id"), "source_row", "errors", *extra)


def reject_reasons(checked):
    return (checked.select(F.explode("errors").alias("reason")).groupBy("reason")
            .agg(F.count("*").alias("rows")))


def load_quality(checked):
    """One row: source, accepted and rejected counts, reject rate (1 for an empty load), fingerprint."""
    bad = F.count_if(F.size("errors") > 0)
    return checked.agg(
        F.count("*").alias("source_rows"), (F.count("*") - bad).alias("accepted_rows"), bad.alias("rejected_rows"),
        F.when(F.count("*") > 0, bad / F.count("*")).otherwise(F.lit(1.0)).alias("reject_rate"),
        F.max("source_sha256").alias("source_sha256"))


def envelope_violations(envelopes):
    """Deliveries whose identity is unusable; any row here refuses the whole batch.

    Identity columns may be VARIANT (JSON type checked, so ``true`` or ``"3"`` is not an integer) or typed.
    """
    types = dict(envelopes.dtypes)

    def whole_number(name, minimum):
        column = F.col(name)
        if types[name] == "variant":
            typed = F.schema_of_variant(column).isin("BIGINT", "INT", "SMALLINT", "TINYINT")
            value = F.try_variant_get(column, "$", "bigint")
            return F.coalesce(typed & (value >= minimum), F.lit(False))
        return F.coalesce(column >= minimum, F.lit(False))

    source = F.col("source_sha256")
    if types["source_sha256"] == "variant":
        source = F.try_variant_get(source, "$", "string")
    reasons = F.array_compact(F.array(
        F.when(~is_sha256(source), F.lit("source_sha256")),
        F.when(~whole_number("source_row", 2), F.lit("source_row")),
        F.when(~whole_number("revision", 1), F.lit("revision"))))
    return envelopes.withColumn("violations", reasons).filter(F.size("violations") > 0)


def quality_gate(stats, max_reject_rate=0.01):
    """One row ``(reject_rate, events, passed)`` from merge statistics or load quality."""
    return stats.select("reject_rate", "events", (
        (F.col("reject_rate") <= F.lit(float(max_reject_rate))) & (F.col("events") > 0)).alias("passed"))


def enforce(gate, message):
    """Fail unless the one-row ``passed`` gate holds."""
    row = gate.first()
    if row is None or not row["passed"]:
        raise ValueError(f"{message}: {row.asDict() if row else 'no rows'}")
    return row
