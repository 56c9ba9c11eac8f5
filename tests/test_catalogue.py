"""Every core query against its SQL, on the smallest test tables."""

import glob
import math
import os

import duckdb
import pytest

from lathework.plans import catalogue


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    df = catalogue.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalogue.SQL:
        return
    r = duck.sql(catalogue.SQL[name])
    names = list(r.columns)
    assert sorted(names) == columns
    assert got == sorted((tuple(norm(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)


def test_sql_names_are_queries():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(e.queries())
