import os

import pytest
from tests.oracle import connect, spark_rows, sql_rows

from prefixlens.llm import queries as Q

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, name):
    columns, rows = spark_rows(Q.QUERIES[name](spark, BASE))
    assert len(set(columns)) == len(columns)
    if name in Q.SQL:
        assert (columns, rows) == sql_rows(connect(BASE), Q.SQL[name])
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))
