import os

import duckdb
import pytest

from folioforge.plans import catalog, delivery, documents, pages, structure, translate  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def plain(rows):
    return sorted(repr(tuple(x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = plain(df.select(*names).collect())
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    rel = duck.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    want = plain([tuple(r[cols.index(n)] for n in names) for r in rel.fetchall()])
    assert got == want and want
