"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cutline.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


def normal(p: pd.DataFrame) -> pd.DataFrame:
    p = p[sorted(p.columns)].copy()

    def one(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return ""
        if hasattr(x, "year"):
            return str(pd.Timestamp(x))
        if isinstance(x, (float, np.floating, int, np.integer)) and not isinstance(x, (bool, np.bool_)):
            return f"{round(float(x), 5) + 0.0:.5f}"
        return str(x)

    for c in p:
        p[c] = p[c].map(one)
    return p.sort_values(list(p.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, oracle, name):
    got, want = normal(catalog.QUERIES[name](spark, DATA).toPandas()), normal(oracle.execute(catalog.ORACLE_SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    apart = (got != want).any(axis=1)
    assert not apart.any(), f"{got[apart].head(3)}\n{want[apart].head(3)}"


@pytest.mark.parametrize("name", ["residual_test", "fingerprint", "scenario_grid", "platt_accept"])
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0
