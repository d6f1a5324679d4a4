"""Every registered query that has SQL against DuckDB, on the smallest tables."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from panelrisk.plans.catalogue import REGISTRY

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
NAMES = [n for n, q in REGISTRY.items() if q.sql]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def table(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = REGISTRY[name].run(spark, FOLDER)
    want = duck.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert table(got.columns, got.collect()) == table(columns, want.fetchall())


def test_contract():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert all(q.rows and q.columns for q in REGISTRY.values())


def test_neighbours_and_fits_stay_out_of_the_base_matrix():
    from panelrisk.operators.checks import forbidden_columns

    assert forbidden_columns([n for n, _ in REGISTRY["feature_matrix"].columns]) == []
