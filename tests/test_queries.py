"""Every registered query of the core against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from loomcorpus import plans

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        p = f"{D}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(repr(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_matches_sql(spark, db, name):
    df = plans.queries()[name](spark, D)
    got = df.collect()
    sql = plans.oracles().get(name)
    if sql is None:
        assert got
        return
    want = db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
