"""Every registered query of the engine against its SQL, on the smallest test tables."""

import os
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__
from lodeseek import catalogue

TABLES = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    """A value in a form that is the same from either engine."""
    if isinstance(value, list | tuple | np.ndarray):
        return "[" + ",".join(map(plain, value)) + "]"
    if value is None or (isinstance(value, float) and np.isnan(value)):
        return "null"
    if isinstance(value, bool | np.bool_):
        return str(bool(value))
    if isinstance(value, int | float | np.integer | np.floating):
        return repr(float(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = __spark_entry__.queries()[name](spark, str(TABLES))
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    want = sql.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
