"""Every registered query of the package against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

from concordat.plans.catalog import QUERIES, SQL

HERE = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{HERE}/{t}.parquet'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, HERE)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*names).collect())
    quoted = ", ".join(f'"{c}"' for c in names)
    want = sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())
    assert got == want
