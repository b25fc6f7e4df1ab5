"""The driver's contract, and queries against their SQL on the smallest tables."""

import datetime
import math
import os

import pytest

import __spark_entry__ as entry
from quillgraph.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("<NA>", "NaT"):
        return None
    if isinstance(v, datetime.datetime):
        return str(v)
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(canon, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=str)
    assert rows(got) == rows(want)


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["rank", "id"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
