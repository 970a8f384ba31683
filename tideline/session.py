"""Session settings and the shared scratch area."""
import tempfile
import uuid

from pyspark.sql import SparkSession

_one_machine = {}


def build_session(master=None, app="tideline", partitions=None, **conf):
    """A session with the settings the jobs rely on: UTC, ANSI, AQE with skew handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark):
    """The shared folder named by ``spark.checkpoint.dir``. On a cluster that names none, this ends the job: a machine's own folder is not seen by others."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _one_machine.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tideline-"))


def scratch_path(spark, name):
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name, partition_by=None, compact=False):
    """Write an intermediate result to the shared folder and read it back.

    Cuts lineage with files that outlive any executor, gives later stages column
    pruning, and gives the planner true sizes (so only truly small tables are broadcast).
    ``compact`` is for large tables: they are packed tighter, and the shuffle files behind them go as soon as they are written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if compact:
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            writer.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    else:
        writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch = path
    return stored


def discard(*tables):
    """Delete tables that ``materialize`` returned. Nothing that is still to be computed may read them."""
    for table in tables:
        path, system = file_system(table.sparkSession, table.scratch)
        system.delete(path, True)


def read_table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_system(spark, path):
    """A path as Hadoop knows it, and its file system."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark, path):
    jvm_path, system = file_system(spark, path)
    return system.exists(jvm_path)


def qualified(spark, path):
    """The path with scheme, as scans name their files."""
    jvm_path, system = file_system(spark, path)
    return system.makeQualified(jvm_path).toString()
