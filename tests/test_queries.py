"""Every registered query of the core against its SQL on the smallest tables."""

from importlib import import_module

import __spark_entry__ as entry
import pytest
from compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
CORE = [import_module(m) for m in entry.MODULES]
QUERIES = {name: f for m in CORE for name, f in m.QUERIES.items()}
SQL = {name: sql for m in CORE for name, sql in m.SQL.items()}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, FOLDER, name, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert len(set(df.columns)) == len(df.columns) > 0
    # the smallest tables leave nothing without a unit, and no name to compare
    assert df.count() > 0 or name in ("p2_review", "fix_by_name")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
