"""Queries of this package and the SQL that states the same rows."""
QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap
