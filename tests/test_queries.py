"""Every query with SQL against DuckDB at sf0.001."""

import math
import os

import duckdb
import pytest

from rankfile.plans import registry
from rankfile.plans.core import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    q = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in q.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(1).count() == 1
