"""The registered queries on the smallest tables, against DuckDB where there is SQL."""

import os

import pytest

from sylva.llm import queries
from sylva.llm.oracle import ORACLE_SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(frame):
    return sorted(tuple(map(str, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(ORACLE_SQL)))
def test_without_sql(spark, name):
    out = queries.QUERIES[name](spark, SF)
    source = {"op2": "pages", "op9": "conversations"}.get(name.split("_")[0], "documents")
    assert out.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()
