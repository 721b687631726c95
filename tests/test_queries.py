"""Every registered query against its SQL on the smallest tables, as the driver compares them."""

import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
OWN = entry._own()[0]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return f"{v:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, duck, name):
    df = OWN[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    if name in entry.oracle_sql():
        found = duck.execute(entry.oracle_sql()[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
        assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
