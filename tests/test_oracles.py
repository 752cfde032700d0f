"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from tidemark.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def plain(rows, names):
    cell = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(cell(v) for v in row) for row in rows), key=repr), sorted(names)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert columns
        return
    found = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in columns]
    assert plain(rows, columns) == plain([tuple(r[k] for k in order) for r in found.fetchall()], names)


def test_entry(spark, duck):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns and set(driver.oracle_sql()) <= set(driver.queries())
