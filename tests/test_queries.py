"""Every core query against its DuckDB SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from latticeflow.plans.queries import ORACLE, QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, DATA)
    want = con.sql(ORACLE[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
