"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tillroll.plans.catalog import QUERIES
from tillroll.plans.oracle import ORACLE
from tillroll.sources.testbed import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(E.oracle_sql()) <= set(E.queries())


SPARK_TO_SQL = {"IntegerType()": "INTEGER", "LongType()": "BIGINT", "DoubleType()": "DOUBLE",
                "StringType()": "VARCHAR", "DateType()": "DATE", "BooleanType()": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows, scols = df.collect(), df.columns
    rel = con.sql(E.oracle_sql()[name])
    dcols, dtypes = rel.columns, [str(t) for t in rel.types]
    drows = rel.fetchall()
    assert sorted(scols) == sorted(dcols)
    stypes = {f.name: SPARK_TO_SQL.get(repr(f.dataType), repr(f.dataType)) for f in df.schema.fields}
    assert stypes == dict(zip(dcols, dtypes))
    assert canon(scols, srows) == canon(dcols, drows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "month", "outlet_name", "brand", "mtd_sales", "mtd_bills", "mtd_abv"]
    assert df.count() > 0


def test_every_query_is_traced_to_the_survey():
    from tillroll.plans.catalog import QUERIES, SURVEY_IDS
    assert set(QUERIES) == set(SURVEY_IDS)
