"""Every registered signal query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from sigtables.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).is_dir():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def key(row):
    return tuple("null" if x is None else f"{x:.4f}" if isinstance(x, float) and math.isfinite(x) else str(x) for x in row)


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found), key=key)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or a != a and b != b or abs(a - b) <= 1e-9 * max(1.0, abs(a))
    return str(a) == str(b)


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want) > 0
    assert [(a, b) for a, b in zip(got, want, strict=True) if not all(map(same, a, b))] == []
