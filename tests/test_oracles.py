"""Every registered structure query against its SQL, at the smallest scale."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from molquarry.plans import registry

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return c


def text(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    try:
        return f"{float(v) + 0.0:.8g}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(text, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_as_sql(name, spark, sf_dir, duck):
    assert rows(registry.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(registry.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
