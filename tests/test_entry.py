from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from placewise.plans import queries

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple("~" if v is None or (isinstance(v, float) and math.isnan(v)) else repr(v) for v in (r[i] for i in order)) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.queries()))
def test_query_equals_sql(spark, db, name):
    got = queries.queries()[name](spark, str(DATA))
    want = db.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(queries.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if DATA.exists():
        assert __spark_entry__.entry(spark).count() > 0
