"""Every query against its SQL, on the smallest tables."""

import glob
import math
import os

import pytest

from corpusloom import catalog

duckdb = pytest.importorskip("duckdb")
SLOW = {"ml_cv", "ml_calibrated", "ml_label_merge", "ml_held_out"}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if isinstance(v, (int, bool)) or v is None else str(v)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows
        return
    r = con.execute(catalog.SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(rows, df.columns) == table(r.fetchall(), columns)


def test_entry():
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_flagship(spark, sf):
    assert {r["split"] for r in catalog.flagship(spark, sf).collect()} == {"train", "dev", "calib", "test"}
