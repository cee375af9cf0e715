"""The queries of this subpackage against their SQL, and the others for rows."""

import os

import duckdb
import pytest

from figloom.llm import queries
from tests.test_queries import D, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f.split('.')[0]} as select * from '{D}/{f}'")
    assert rows(queries.QUERIES[name](spark, D).toPandas()) == rows(con.execute(queries.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, D).count() > 0
