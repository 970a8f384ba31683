"""Named queries and the SQL that states the same result independently."""
from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


def rounded(df, digits=6):
    """Round floating columns, so that sums taken in another order compare equal."""
    return df.select(*[F.round(name, digits).alias(name) if kind == "double" else F.col(name)
                       for name, kind in df.dtypes])
