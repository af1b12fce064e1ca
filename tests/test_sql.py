import pytest

from loomgraph.plans import queries

from .sql import FOLDER, differences


@pytest.mark.skipif(not FOLDER.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert differences(spark, queries.queries()[name], queries.oracle_sql()[name]) == ([], [], 0)
