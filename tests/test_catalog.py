"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from papyra import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLES:
        assert rows
        return
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert rows == sorted((tuple(plain(r[c]) for c in columns) for r in expected), key=repr)
