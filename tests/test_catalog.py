"""Every query of the catalogue against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from concordat.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    if name in catalog.ORACLE_SQL:
        cursor = duck.execute(catalog.ORACLE_SQL[name])
        order = [[d[0] for d in cursor.description].index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_every_node_is_chunked(spark):
    from concordat.sources import derived

    got = {(r.node_idx, r.path): r.bytes for r in catalog.cdc_chunks(spark, DATA).collect()}
    files = derived.contents(spark, DATA).filter("tp = 'F'").selectExpr("node_idx", "path", "octet_length(body) AS n").collect()
    assert got == {(r.node_idx, r.path): r.n or 0 for r in files}
    assert {node for node, _ in got} == {0, 1, 2}
