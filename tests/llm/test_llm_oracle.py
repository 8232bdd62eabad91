"""The queries that SQL can express against DuckDB on whole small tables."""

import duckdb
import pytest

import __spark_entry__ as E
from tillroll.llm.oracle import ORACLE
from tillroll.sources.testbed import TABLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.sql(E.oracle_sql()[name])
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    got = sorted(tuple(repr(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(repr(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall())
    assert got == want and got


def test_every_operator_is_registered():
    names = set(E.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
