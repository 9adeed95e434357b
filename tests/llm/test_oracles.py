"""Each corpus query with SQL gives the rows of that SQL."""

import pytest

from terrace.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_larger(name, same_as_sql):
    same_as_sql(QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.01")
