"""Every query of the core against its SQL in DuckDB, on the smallest test data."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from foliant.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return str(bool(v))
    try:
        return f"{float(v):.6g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def _rows(pdf):
    return sorted((tuple(_plain(v) for v in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns) > 0
        return
    wanted = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert _rows(got) == _rows(wanted)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
