"""The registered text queries against their SQL on the smallest tables."""

import pytest

from compare import TESTDATA, difference
from docloom.llm.queries import QUERIES, SQL

DATA = TESTDATA / "sf0.001"
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert difference(spark, name, QUERIES[name], SQL[name], DATA) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0
