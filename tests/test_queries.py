"""Every registered query of the vector engine against its SQL, over the whole small table."""

import os

import pytest

from loomvec.plans import queries as core

SF = os.environ.get("LOOMVEC_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("embeddings", "events", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    got = core.queries()[name](spark, SF).toPandas()
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    a, b = (t[cols].astype(str).sort_values(cols).reset_index(drop=True) for t in (got, want))
    assert a.equals(b)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
