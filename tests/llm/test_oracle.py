"""Every document query that has SQL against it, over whole tables."""

import pytest
from compare import assert_same, connect

from ticklens.llm.oracle import SQL
from ticklens.llm.queries import all_queries

SF_DIR = "/root/testdata/sf0.01"


def test_sql_belongs_to_queries():
    assert SQL.keys() <= all_queries().keys()


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, name):
    assert assert_same(all_queries()[name](spark, SF_DIR), connect(SF_DIR), SQL[name]) > 0
