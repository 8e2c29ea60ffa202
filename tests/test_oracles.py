"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from cladeweave.plans import catalogue

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, "" if isinstance(x, (int, float)) else str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no stored tables here")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    assert rows
    if name in catalogue.ORACLES:
        found = duck.sql(catalogue.ORACLES[name])
        assert sorted(found.columns) == columns
        assert _sorted(rows) == _sorted(tuple(r[found.columns.index(c)] for c in columns) for r in found.fetchall())
