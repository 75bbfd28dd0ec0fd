"""Every core query runs; those with SQL give the rows that DuckDB gives."""

import math
from collections import Counter
from pathlib import Path

import pytest

from factloom.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in catalogue.oracle_sql():
        found = con.execute(catalogue.oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        order = sorted(range(len(names)), key=lambda k: names[k])
        assert got == Counter(tuple(plain(r[k]) for k in order) for r in found.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
