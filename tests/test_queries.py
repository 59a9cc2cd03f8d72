"""Every query of the engine against its SQL on DuckDB: rows, column names and types, in any order."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lodestone.plans import catalogue
from lodestone.sources.readers import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, (datetime.datetime, datetime.date, decimal.Decimal, bool)) or x is None:
        return str(x)
    return f"{type(x).__name__}:{x}"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_oracle(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    expected = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()]
    wanted = [tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in expected.fetchall()]
    assert sorted(rows) == sorted(wanted)
