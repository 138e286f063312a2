"""Every registered core query against its SQL over whole tables of the smallest scale."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from quillspan.plans import registry


def plain(v):
    if v is None or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    return str(v)


def bag(df):
    df = df[sorted(df.columns)]
    return list(df.columns), Counter(tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_as_sql(spark, duck, sf, name):
    assert bag(registry.QUERIES[name](spark, sf).toPandas()) == bag(duck.execute(registry.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scans_read_only_what_they_use(spark, sf):
    plan = registry.QUERIES["s1_scan_clean"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "objective" in plan and "activities" not in plan and "PushedFilters" in plan
