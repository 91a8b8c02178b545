"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from corpusforge.registry import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return repr(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    order = [want.columns.index(c) for c in cols]
    a = sorted("|".join(plain(r[c]) for c in cols) for r in got.collect())
    b = sorted("|".join(plain(r[i]) for i in order) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__

    assert FLAGSHIP in __spark_entry__.queries()
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
