"""DuckDB parity of every SQL-expressible key on the smallest driver tables
(the driver checks the same at sf0.01)."""
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from resolvr.sources.tables import TABLES

SF_SMALL = "/root/testdata/sf0.001"


def _norm(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False):
        out = []
        for v in rec:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
                out.append(None)
            elif isinstance(v, float):
                out.append(round(v, 6))
            elif hasattr(v, "isoformat"):
                out.append(pd.Timestamp(v).isoformat())
            else:
                out.append(v.item() if hasattr(v, "item") else v)
        rows.append(tuple(out))
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_oracle_key_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_parity(spark, duck, name):
    s = E.queries()[name](spark, SF_SMALL).toPandas()
    o = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert _norm(s) == _norm(o)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"model_name", "mse", "rmse", "mae", "r2", "n_samples"}
    assert df.count() == 4
