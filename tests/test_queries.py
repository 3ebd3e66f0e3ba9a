"""Each registered query against its SQL in DuckDB on the smallest tables, as sets of rows."""

import math
import os

import duckdb
import pytest

from tallyboard.plans.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(table: list[tuple]) -> list[tuple]:
    return sorted((tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else str(x) for x in r) for r in table), key=str)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == names
    wanted = duck.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert rows([tuple(r) for r in got.select(*names).collect()]) == rows(wanted)
