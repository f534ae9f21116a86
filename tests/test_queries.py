"""Every query of the engine proper against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from scholium.plans import registry

DIR = "/root/testdata/sf0.001"


def norm(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if hasattr(v, "tolist"):
                v = v.tolist()
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
                out.append("null")
            elif isinstance(v, bool):
                out.append(str(v))
            elif isinstance(v, (int, float)):
                out.append(f"{round(float(v), 6):.6f}")
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    if name in registry.ORACLES:
        want = duck.execute(registry.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert norm(got) == norm(want)
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
