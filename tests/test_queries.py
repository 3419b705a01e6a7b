"""Every registered query against its SQL on the smallest driver tables."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark: SparkSession, name: str) -> None:
    import duckdb

    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    told = ordered(registry.QUERIES[name](spark, SF).toPandas())
    want = ordered(connection.sql(registry.ORACLE_SQL[name]).df())
    assert list(told.columns) == list(want.columns) and len(told) == len(want)
    for column in told.columns:
        a, b = told[column].to_numpy(), want[column].to_numpy()
        if a.dtype.kind in "fiu" or b.dtype.kind in "fiu":
            assert np.array_equal(a.astype(float), b.astype(float), equal_nan=True), column
        else:
            assert list(map(str, a)) == list(map(str, b)), column
