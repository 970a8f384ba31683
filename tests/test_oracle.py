"""Every registered query of the reference's own work against its SQL statement."""
import pytest

import __spark_entry__ as entry
from check_queries import compare, open_tables

SF = "/root/testdata/sf0.01"
NAMES = sorted(name for name in entry.queries() if name.startswith("q_"))


@pytest.fixture(scope="module")
def tables():
    return open_tables(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_statement(spark, tables, name):
    status, count, _, note = compare(spark, tables, name, SF)
    assert status in ("ok", "rows-only") and count > 0, note


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    frame = entry.entry(spark)
    assert frame.count() > 0 and frame.columns == entry.entry(spark).columns
