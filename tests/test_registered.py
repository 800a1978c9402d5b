"""Every registered query with SQL agrees with it on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tessera.plans import queries as Q

HERE = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not HERE.is_dir(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in HERE.glob("*.parquet"):
        c.sql(f"create view {t.stem} as select * from '{t}'")
    return c


def rows(frame):
    def plain(v):
        return None if v is None or v is pd.NA or v != v else float(f"{v:.10g}") + 0.0 if isinstance(v, float) else v  # -0.0 sorts as 0.0

    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query(spark, duck, name):
    got, want = Q.QUERIES[name](spark, str(HERE)).toPandas(), duck.sql(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
