"""Every registered core query against its SQL on the smallest tables."""

import importlib

import pytest

from compare import TESTDATA, difference
from docloom import plans

DATA = TESTDATA / "sf0.001"
PARTS = [importlib.import_module(f"docloom.plans.{m}") for m in plans.MODULES]
QUERIES = {n: q for p in PARTS for n, q in p.QUERIES.items()}
SQL = {n: s for p in PARTS for n, s in p.SQL.items()}

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert difference(spark, name, QUERIES[name], SQL[name], DATA) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
