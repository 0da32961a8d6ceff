"""The corpus queries against their DuckDB SQL."""

import duckdb
import pytest

from latticeflow.llm.queries import ORACLE, QUERIES

TABLES = "documents embeddings pages benchmark labels"


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    want = con.sql(ORACLE[name])
    df = QUERIES[name](spark, data)
    assert df.columns == want.columns
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall()) and got
