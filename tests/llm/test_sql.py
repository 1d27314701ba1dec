"""Every query of the text operators with SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

from stateweave.llm import queries as own

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = own.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    out = con.execute(own.ORACLES[name])
    at = [d[0] for d in out.description]
    assert sorted(at) == columns and len(got) > 0
    assert got == sorted((tuple(r[at.index(c)] for c in columns) for r in out.fetchall()), key=str)
