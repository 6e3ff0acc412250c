"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from casewright.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    assert Counter(tuple(plain(r[c]) for c in columns) for r in rows) == Counter(tuple(plain(r[k]) for k in at) for r in want)
