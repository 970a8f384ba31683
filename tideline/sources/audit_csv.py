"""Reading the source CSV: fingerprint, header check and row ordinals without a global sort."""
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.normalize import validate_headers

#: A quote inside a quoted field is doubled.
DIALECT = {"header": True, "quote": '"', "escape": '"'}


def file_fingerprints(spark, paths):
    """SHA-256 of each file's bytes, computed by the executors (one file per row, so for files that fit a task)."""
    return (spark.read.format("binaryFile").load(paths)
            .select(F.col("path").alias("file"), F.sha2("content", 256).alias("source_sha256"), "length"))


def header_of(spark, path, multi_line=False):
    """Header names of one file; reads its first record. A UTF-8 byte order mark is dropped."""
    return [name.lstrip("\ufeff").strip('"') for name in spark.read.options(**DIALECT, multiLine=multi_line).csv(path).columns]


def broken_files(spark, paths):
    """Files in which some line holds an odd number of quotes, so that a record runs over a line break."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(paths).filter(quotes % 2 == 1).select(F.col("_metadata.file_path").alias("file")).distinct()


def read_audit_csv(spark, paths, fingerprints=None):
    """All columns as strings plus ``source_sha256`` and ``source_row`` (first data record is 2).

    Every file is read by its own header: columns may come in any order, and one that a file lacks is null there. Files with line breaks
    inside quotes are read whole, one task each; all others are split. The driver sees one name per file and its header.

    The row ordinal is the distance from the first row of the same file block plus the rows of earlier blocks.
    Blocks are summarised to one row each; the true size of that table decides how it is joined.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = fingerprints if fingerprints is not None else file_fingerprints(spark, paths)
    broken = {_plain_name(row.file) for row in broken_files(spark, paths).collect()}
    alike = {}
    for row in spark.read.format("binaryFile").load(paths).select("path").orderBy("path").collect():
        multi_line = _plain_name(row.path) in broken
        header = header_of(spark, row.path, multi_line)
        if header:
            validate_headers(header)
            alike.setdefault((tuple(header), multi_line), []).append(row.path)
    if not alike:
        validate_headers([])
    columns = list(dict.fromkeys(name for header, _ in alike for name in header))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True),
                  [_numbered(spark, names, header, multi_line) for (header, multi_line), names in alike.items()])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (rows.groupBy("file", "block").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
              .join(files.select(plain_path(F.col("file")).alias("plain"), "source_sha256"),
                    F.col("plain") == plain_path(F.col("file"))).drop("plain"))
    return (rows.join(blocks, ["file", "block"])
            .withColumn("source_row", (F.col("seq") - F.col("first") + F.col("before") + 2))
            .select("source_sha256", "source_row", *columns))


def _numbered(spark, paths, header, multi_line):
    """Records of files that share a header, with their file, block and place in the scan."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    return (spark.read.schema(schema).options(**DIALECT, multiLine=multi_line, enforceSchema=True).csv(paths)
            .select("*", F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")))


def plain_path(column):
    """``file:/x`` and ``file:///x`` name the same file."""
    return F.regexp_replace(column, "^([a-z0-9]+):/+", "$1:/")


def _plain_name(path):
    scheme, _, rest = path.partition(":/")
    return f"{scheme}:/{rest.lstrip('/')}"
