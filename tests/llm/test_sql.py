import pytest

from loomgraph.llm import queries
from tests.sql import FOLDER, differences


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert differences(spark, queries.queries()[name], queries.oracle_sql()[name]) == ([], [], 0)


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, name):
    assert queries.queries()[name](spark, str(FOLDER)).count() >= 0
