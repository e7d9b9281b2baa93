"""Every query with an SQL counterpart, compared with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_file
from ebbtide.plans.oracles import ORACLES
from ebbtide.plans.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "orders", "events")
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return f"{value + 0.0:.8f}"
    return str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    text = ORACLES[name]
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    described = {row[0]: row[1] for row in duck.execute(f"DESCRIBE {text}").fetchall()}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == described
    ours = sorted(tuple(cell(row[c]) for c in columns) for row in df.collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted(tuple(cell(v) for v in row) for row in duck.execute(f"SELECT {quoted} FROM ({text})").fetchall())
    assert ours == theirs
    assert ours


def test_entry_runs(spark):
    assert entry_file.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())
    assert set(QUERIES) <= set(entry_file.queries())
