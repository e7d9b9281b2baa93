import os

import duckdb
import pytest

from ebbtide.llm.oracles import ORACLES
from ebbtide.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    quoted = ", ".join(f'"{c}"' for c in df.columns)
    ours = sorted(map(str, (tuple(r) for r in df.collect())))
    assert ours and ours == sorted(map(str, con.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall()))


def test_one_query_of_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
