"""Queries of the operators that SQL can say give the rows that DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from quarry.llm import queries

SF = "/root/testdata/sf0.001"


def plain(x):
    return "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.4f}" if isinstance(x, float) else str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([plain(r[i]) for i in order] for r in data)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = queries.queries()[name](spark, SF)
    cur = con.execute(queries.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())
