"""Every query of the raster engine against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from pixelmill.plans import codec_queries, jpeg_queries, pixel_queries  # noqa: F401  each registers its queries
from pixelmill.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def test_all_have_oracles():
    assert set(QUERIES) == set(ORACLES)


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, duck):
    got = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(repr(tuple(plain(r[c]) for c in names)) for r in got.collect())
    assert rows == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT"}
    assert {c: kinds[t] for c, t in got.dtypes} == {c[0]: str(c[1]) for c in want.description}
