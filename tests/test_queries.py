"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sparkwright import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if out[c].dtype.kind in "iuf" or str(out[c].dtype) in ("Int64", "Float64", "Int32"):
            out[c] = out[c].astype("float64").round(5) + 0.0
        out[c] = out[c].astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = plain(registry.queries()[name](spark, SF).toPandas())
    want = plain(duck.execute(registry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
