import pytest

from tessera.llm import queries
from tests.conftest import DATA
from tests.oracle import connection, difference

SF = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), connection(SF), queries.ORACLE[name]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
