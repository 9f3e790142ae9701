"""Every query of the library against the SQL that gives the same rows."""

import pytest

from folio.plans import registry
from tests import oracle

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return oracle.connection(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, con, name):
    assert oracle.of_spark(registry.queries()[name](spark, data)) == oracle.of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_other_queries_have_rows(spark, data, name):
    assert registry.queries()[name](spark, data).limit(1).count() == 1


def test_entry_has_a_stable_schema(spark, data):
    assert registry.flagship(spark, data).columns == ["doc_id", "node", "title", "start", "end", "depth", "parent", "origin"]
