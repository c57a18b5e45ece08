import os

import duckdb
import pytest

from concordat.llm.queries import oracle_sql, queries

HERE = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", oracle_sql())
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{HERE}/{t}.parquet'")
    df = queries()[name](spark, HERE)
    names = sorted(df.columns)
    got = sorted(map(tuple, df.select(*names).collect()))
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({oracle_sql()[name]})").fetchall())
    assert got == want


def test_every_operator_is_registered():
    found = {name.split("_")[0] for name in queries()}
    assert found == {f"op{n}" for n in range(1, 14)}
