"""Every query of the library's own that SQL can express gives the SQL's rows."""

import pytest

from oracle import assert_same, connect
from peerglyph.plans.catalog import all_queries

QUERIES, SQL = all_queries()


@pytest.fixture(scope="module")
def db(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf_dir, db, name):
    assert_same(QUERIES[name](spark, sf_dir), db, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).columns
