"""Every registered query of the engine against its DuckDB SQL oracle, at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from segmint.plans import catalog
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(catalog.oracle_sql()) == set(catalog.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["id", "segs"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(catalog.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    # same column types in both engines (the driver compares schemas too)
    spark_types = {f.name: SQL_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == {c[0]: str(c[1]) for c in res.description}
    assert rows_of(df.columns, srows) == rows_of(dcols, drows)
