import os

import pytest
from tests.oracle import connect, spark_rows, sql_rows

from prefixlens.plans import registry

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    columns, rows = spark_rows(registry.QUERIES[name](spark, BASE))
    assert len(set(columns)) == len(columns)
    if name in registry.SQL:
        assert (columns, rows) == sql_rows(connect(BASE), registry.SQL[name])


def test_registry_and_entry(spark):
    import __spark_entry__ as entry

    assert registry.SQL.keys() <= registry.QUERIES.keys() and registry.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0


def test_registered_queries_take_tables_whole(spark, monkeypatch):
    from prefixlens.plans import analysis_queries as A
    from prefixlens.sources import records as R

    class Longer:
        """Lines that count as more than the command line's limit."""

        def count(self):
            return 30_000_000_000

    loaded = R.load_requests(spark.createDataFrame([], "input_line long, captured_at string, source string, session_key string, comparison map<string,string>, payload string"))
    numbered = []
    monkeypatch.setattr(R, "row_numbers", lambda df, *a: numbered.append(df) or df.withColumn("_n", df["input_line"]))
    assert R._budget(loaded, Longer(), A.OPTIONS) is loaded and not numbered
