"""Every registered spatial query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from plexgrid.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted(([plain(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = catalogue.queries()[name](spark, DIR)
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalogue.queries()[name](spark, DIR).count() > 0


def test_every_tile_has_an_embedding(spark):
    got = {(r["patch_id"], r["c"]): r["value"] for r in catalogue.queries()["embed_tiles"](spark, DIR).collect()}
    assert set(got) == {(k, c) for k in range(16) for c in "FO"} and any(v > 0 for v in got.values())
