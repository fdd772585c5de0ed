"""Every registered query of the core against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from lodestone import queries
from tests.conftest import DATA

FOLDER = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = queries.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    ran = duck.execute(sql)
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in ran.fetchall()) == got
