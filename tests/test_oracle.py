"""Every registered query of the reference's kind against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from vellumist.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (str, bool)) or v is None:
        return v
    f = float(v)
    return None if math.isnan(f) else round(f, 5)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        assert rows
        return
    got = duck.execute(registry.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    assert sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in got.fetchall()), key=repr) == rows
