"""Publishing one consistent set of tables behind a pointer that is written last.

Every attempt writes into folders of its own: ``data/attempt=…/table=…/slot=…``. A slot is one part of a table (a range of incidents, or all of it)
as one attempt wrote it. The manifest of a commit names the slots that are live, so an increment writes the parts it changed and takes the others
over by name. Readers scan the table's folders joined to the live slots, which prunes partitions at run time; one manifest is read, however many
commits there are.
"""
import json
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.timecols import date_key, hours_between, ntz
from tideline.operators.normalize import enforce
from tideline.operators.star import enforce_integrity
from tideline.session import exists, file_system

POINTER = T.StructType([
    T.StructField("sequence", T.IntegerType()), T.StructField("attempt", T.StringType()),
    T.StructField("run_id", T.StringType()), T.StructField("as_of", T.StringType()),
    T.StructField("dataset_sha256", T.StringType()), T.StructField("generated_at", T.StringType()),
    T.StructField("quality", T.StringType())])
MANIFEST = "name string, part string, slot string, latest timestamp_ntz"

# Published tables; ``incidents`` is another name for the snapshot fact.
ALIASES = {"incidents": "fact_incident_snapshot"}
APPEND_ONLY = ("event_revisions", "quarantine", "processed", "refused_files", "run_statistics", "reject_reasons")
#: Tables kept by ranges of incidents. The snapshot is kept without what only the cutoff decides.
BY_PART = ("events", "segments", "incident_state", "fact_incident_history", "part_members", "part_flows", "part_profile")
WHOLE = "all"
#: Live slots up to this number are broadcast (about 150 bytes each) and prune the scan; more are joined without.
BROADCAST_SLOTS = 200_000


class PointerTaken(ValueError):
    """Another writer took the sequence number first; nothing was published."""


def run_identity(selected, cutoff, code_version):
    """Deterministic run id of (delivered batches, cutoff, code). Independent of row order; one row is read."""
    columns = [F.col(name) for name in ("batch_id", "sha256", "available_as_of")]
    row = selected.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("a"),
                       F.bit_xor(F.xxhash64(F.lit("salt"), *columns)).alias("b")).select(
        F.substring(F.sha2(F.concat_ws("|", "n", F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0)),
                                       F.lit(str(cutoff)), F.lit(code_version)), 256), 1, 20)).first()
    return row[0]


def _sequence_path(root, sequence):
    return f"{root}/commits/n={sequence:08d}"


def latest_sequence(spark, root):
    """Highest committed sequence from the folder names alone; 0 before the first publication."""
    path, system = file_system(spark, f"{root}/commits")
    if not system.exists(path):
        return 0
    return max((int(item.getPath().getName()[2:]) for item in system.listStatus(path) if item.getPath().getName().startswith("n=")), default=0)


def read_pointer(spark, root, sequence=None):
    """Latest commit (or that of ``sequence``) as a Row, or None before the first publication."""
    sequence = sequence or latest_sequence(spark, root)
    return spark.read.schema(POINTER).json(_sequence_path(root, sequence)).first() if sequence else None


def check_succession(previous, as_of, dataset_sha256):
    if previous is None:
        return
    if str(as_of) < previous["as_of"]:
        raise ValueError("The cutoff lies before the published one")
    if previous["dataset_sha256"] != dataset_sha256:
        raise ValueError("The published tables come from another dataset")


def new_attempt(run_id):
    return f"{run_id}-{uuid.uuid4().hex[:8]}"


def slot_name(part, attempt):
    return F.concat(F.lit("p"), part.cast("string"), F.lit(f"-{attempt}"))


def _folder(root, attempt, name):
    return f"{root}/data/attempt={attempt}/table={name}"


def write_parts(table, root, attempt, name, within=()):
    """Write the parts of a table that this attempt changed. Rebalancing keeps files even: parts with many rows are split, small ones share a task."""
    (table.withColumn("slot", slot_name(F.col("part"), attempt)).hint("rebalance", "slot").write.mode("errorifexists")
     .partitionBy("slot", *within).parquet(_folder(root, attempt, name)))


def write_whole(table, root, attempt, name, within=()):
    (table.withColumn("slot", F.lit(f"{WHOLE}-{attempt}")).write.mode("errorifexists").partitionBy("slot", *within).parquet(_folder(root, attempt, name)))


def write_manifest(manifest, root, attempt):
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{root}/data/attempt={attempt}/manifest")


def read_manifest(spark, root, pointer):
    return spark.read.schema(MANIFEST).parquet(f"{root}/data/attempt={pointer['attempt']}/manifest")


def live_slots(spark, root, slots, name, one=False):
    """Rows of a table that lie in ``slots`` (column ``slot``; ``one``: a single row). Other slots are pruned at run time."""
    wanted = slots.filter(F.col("slot") > "").select("slot")
    few = one or wanted.limit(BROADCAST_SLOTS + 1).count() <= BROADCAST_SLOTS
    rows = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data/attempt=*/table={name}")
    return rows.join(F.broadcast(wanted) if few else wanted, "slot", "left_semi").drop("attempt", "table", "slot")


def with_cutoff(state, as_of):
    """The snapshot fact: kept state plus the two columns that follow from the cutoff."""
    return state.withColumns({"age_hours": hours_between(F.col("opened_at"), ntz(as_of)), "snapshot_date_key": date_key(ntz(as_of))})


def published_table(spark, root, name, pointer=None):
    """A table of the latest (or the given) commit."""
    pointer = pointer or read_pointer(spark, root)
    name = ALIASES.get(name, name)
    if name == "fact_incident_snapshot":
        return with_cutoff(published_table(spark, root, "incident_state", pointer), pointer["as_of"])
    live = read_manifest(spark, root, pointer).filter(F.col("name") == name)
    return live_slots(spark, root, live, name)


def register_views(spark, root, names, prefix=""):
    """Catalog names over the committed attempt, including the alias."""
    pointer = read_pointer(spark, root)
    for name in [*names, *[alias for alias, target in ALIASES.items() if target in names]]:
        published_table(spark, root, name, pointer).createOrReplaceTempView(prefix + name)


def create_catalog_tables(spark, root, names, database="default"):
    """Catalog tables over the committed slots; recreated when a commit follows. A table's partitions point to the folders of the attempts that wrote them."""
    pointer = read_pointer(spark, root)
    manifest = read_manifest(spark, root, pointer)
    for name in [*names, *[alias for alias, target in ALIASES.items() if target in names]]:
        target = ALIASES.get(name, name)
        stored = "incident_state" if target == "fact_incident_snapshot" else target
        table = name if stored == target else f"{name}_state"
        slots = [row["slot"] for row in manifest.filter(F.col("name") == stored).select("slot").collect()]
        schema = live_slots(spark, root, manifest.filter(F.col("name") == stored), stored).schema
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
        extra = [field.name for field in schema if field.name == "source_bucket"]
        spark.sql(f"DROP VIEW IF EXISTS {database}.{name}") if table != name else None
        spark.sql(f"DROP TABLE IF EXISTS {database}.{table}")
        spark.sql(f"CREATE TABLE {database}.{table} ({columns}, slot string) USING parquet PARTITIONED BY (slot{''.join(', ' + x for x in extra)}) "
                  f"LOCATION '{root}/catalog/{database}/{table}'")
        places = [(slot, f"{root}/data/attempt={slot.partition('-')[2]}/table={stored}/slot={slot}") for slot in slots]
        specs = [(f"slot = '{slot}'", place) for slot, place in places]
        if extra:
            specs = [(f"{spec}, source_bucket = {folder.partition('=')[2]}", f"{place}/{folder}") for spec, place in specs for folder in _children(spark, place)]
        for start in range(0, len(specs), 200):
            added = " ".join(f"PARTITION ({spec}) LOCATION '{place}'" for spec, place in specs[start:start + 200])
            spark.sql(f"ALTER TABLE {database}.{table} ADD {added}")
        if table != name:
            cutoff = f"TIMESTAMP_NTZ '{pointer['as_of']}'"
            spark.sql(f"CREATE OR REPLACE VIEW {database}.{name} AS SELECT * EXCEPT (slot), timestampdiff(MICROSECOND, opened_at, {cutoff}) / 3.6e9D AS age_hours, "
                      f"cast(date_format({cutoff}, 'yyyyMMdd') AS int) AS snapshot_date_key FROM {database}.{table}")


def _children(spark, path):
    jvm_path, system = file_system(spark, path)
    return [item.getPath().getName() for item in system.listStatus(jvm_path) if "=" in item.getPath().getName()]


# Column order of the two public CSV files.
QUEUE_CSV = ("group", "incidents", "open", "reopened", "reassigned")
FORECAST_CSV = {"target": "date", "series": "series", "forecast": "forecast", "lower": "lower", "upper": "upper",
                "daily_capacity": "daily_capacity", "above_capacity": "demand_above_capacity"}


def export_queue_csv(filtered_groups, path):
    """Queue health per group; the text column is quoted."""
    filtered_groups.select(*QUEUE_CSV).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def export_forecast_csv(excess, path):
    """Forecast days with the demand above a daily capacity."""
    excess.select(*[F.col(name).alias(shown) for name, shown in FORECAST_CSV.items()]).write.mode("overwrite").option(
        "header", True).csv(path)


def take_sequence(spark, root, sequence, row):
    """Put a written pointer in place for ``sequence``, or raise ``PointerTaken``.

    The pointer is written beside its place and renamed: where the place is free, renaming a folder is one step. Where another writer's folder stands there
    already, a file system either refuses or moves the folder inside it, under a hidden name that readers skip. So reading the place back tells who was first.
    """
    attempt = row[1]
    place, stage = _sequence_path(root, sequence), f"{root}/commits/_stage-{attempt}"
    spark.createDataFrame([row], POINTER).coalesce(1).write.mode("errorifexists").json(stage)
    if not exists(spark, place):
        source, system = file_system(spark, stage)
        system.rename(source, file_system(spark, place)[0])
    won = spark.read.schema(POINTER).json(place).first()
    if won is None or won["attempt"] != attempt:
        raise PointerTaken(f"commit {sequence} was taken by attempt {won['attempt'] if won else 'unknown'}")
    return won


def commit(spark, root, attempt, run_id, as_of, dataset_sha256, quality, generated_at, gate, checks, after):
    """Gates first, pointer last. ``after`` is the sequence this attempt was built on: if a commit came in between, it is refused."""
    enforce(gate, "Quality gate failed")
    enforce_integrity(checks)
    row = (after + 1, attempt, run_id, str(as_of), dataset_sha256, str(generated_at), json.dumps(quality))
    return take_sequence(spark, root, after + 1, row)
