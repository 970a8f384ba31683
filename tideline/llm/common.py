"""What several operators share: the shared folder, stored intermediates, word patterns, seeded hashes."""
import tempfile
import uuid

from pyspark.sql import functions as F

#: Words as the contracts take them: runs of anything but the ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own = {}


def shared_folder(spark):
    """The folder of ``spark.checkpoint.dir``. Only a one-machine session that names none gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="corpus-"))


def stored(df, name):
    """Write an intermediate table to the shared folder and read it back: lost executors then cost a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sieved(df, keys, column, most=1 << 25):
    """The rows of ``df`` whose ``column`` may be among ``keys``, and those for which it is not. Nothing is exchanged.

    A bit set over hashes of the keys, of 16 to 32 bits a key and at most ``most``, is one row and broadcast. All rows with one of the keys are in the first
    part, with about one other row in 16 or fewer (more where ``most`` binds); an exact join is then needed for that part alone. ``keys`` is read twice: store it.
    """
    size = min(most, 1 << max(12, (16 * keys.count() - 1).bit_length()))
    place = f"pmod(xxhash64(cast(`{column}` as {keys.schema[column].dataType.simpleString()})), {size})"
    masks = keys.selectExpr(f"{place} as bit").groupBy(F.expr("bit div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask"))
    every = df.sparkSession.range(size // 64).withColumnRenamed("id", "at").join(masks, "at", "left").select("at", F.coalesce("mask", F.lit(0)).alias("mask"))
    bits = every.agg(F.sort_array(F.collect_list(F.struct("at", "mask"))).alias("masks")).select(F.transform("masks", lambda x: x["mask"]).alias("sieve_"))
    bits, found = F.broadcast(stored(bits, "sieve")), F.expr(f"getbit(get(sieve_, cast({place} div 64 as int)), cast({place} % 64 as int)) = 1")
    return df.join(bits, found, "left_semi"), df.join(bits, found, "left_anti")


def bound_batches(spark, size="8m", rows=2000):
    """Keep Arrow batches small, whatever the length of a text: Python workers then hold a few MB at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column="text"):
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def literal_array(values, kind):
    """A constant array as one parsed string: it is folded into one literal, however long it is."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"
