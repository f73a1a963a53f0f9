"""The registered queries that have SQL against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from scriptflow.llm import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def test_all_are_registered():
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    result = registry.queries()[name](spark, SF_DIR)
    columns = ", ".join(sorted(result.columns))
    sql = f"SELECT {columns} FROM ({registry.oracle_sql()[name]})"
    expected = sorted(con.execute(sql).fetchall(), key=str)
    assert sorted(map(tuple, result.select(*sorted(result.columns)).collect()), key=str) == expected
