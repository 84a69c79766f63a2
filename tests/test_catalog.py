"""Every query of the catalogue at the smallest size, against its SQL in DuckDB."""

import functools
import os

import duckdb
import pytest

from lectern.plans import catalog, trade

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("the driver's tables aren't here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_trade_course():
    """The trade course is resolved once for all queries that read it."""
    with pytest.MonkeyPatch.context() as m:
        for name in ("resolved", "graph", "lines"):
            m.setattr(trade, name, functools.cache(getattr(trade, name)))
        yield


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_parity(spark, db, name):
    df = catalog.QUERIES[name](spark, DATA)
    cur = db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir(DATA):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
