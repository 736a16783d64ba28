"""Every core query with SQL agrees with it on a whole small data set."""

import pytest

from tessera.plans import registry
from tests.conftest import DATA
from tests.oracle import connection, difference

NAMES = sorted(registry.queries())
SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", [n for n in NAMES if n in registry.oracle_sql()])
def test_query_equals_sql(spark, name):
    assert difference(registry.queries()[name](spark, SF), connection(SF), registry.oracle_sql()[name]) == ([], [])


@pytest.mark.parametrize("name", [n for n in NAMES if n not in registry.oracle_sql()])
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() > 0
