"""Every core query with SQL gives the same rows in Spark and in DuckDB."""

import glob
import importlib
import math
import os

import duckdb
import pytest

MODULES = ("skew", "accounts", "retrieval", "pipeline")
QUERIES = {n: f for m in MODULES for n, f in importlib.import_module(f"quillspan.plans.{m}").QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in importlib.import_module(f"quillspan.plans.{m}").SQL.items()}


@pytest.fixture(scope="module")
def db(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, small, name):
    df = QUERIES[name](spark, small)
    cur = db.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    mine = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(norm(dict(zip(names, r))[c]) for c in order) for r in cur.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
