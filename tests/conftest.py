"""One local session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.cellwright.partitionsPerCore", "1").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def same(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if both hold the same rows, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    cols = sorted(want.columns)
    key = lambda d: sorted(tuple("null" if v is None or v is pd.NA or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.9g}" if isinstance(v, float) else str(list(v) if hasattr(v, "tolist") and getattr(v, "shape", ()) else v) for v in r) for r in d[cols].itertuples(index=False))
    a, b = key(got.convert_dtypes()), key(want.convert_dtypes())
    if a != b:
        return f"{len(a)} and {len(b)} rows; only here {[x for x in a if x not in set(b)][:3]}; only there {[x for x in b if x not in set(a)][:3]}"
    return None
