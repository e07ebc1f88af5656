"""Every query with an oracle, against DuckDB on the same files."""

import glob
import os
from numbers import Number

import duckdb
import numpy as np
import pandas as pd
import pytest

from ledgerloom import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    text = lambda x: "None" if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x)
    out = []
    for r in df.itertuples(index=False):
        out.append(tuple(text(x if pd.isna(x) or not isinstance(x, Number) or isinstance(x, (bool, np.bool_)) else float(x)) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0
