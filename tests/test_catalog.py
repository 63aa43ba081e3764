"""Every query against its SQL on the same tables."""

import os

import duckdb
import pytest

from strandlake.plans import catalog

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    return round(x, 6) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    key = lambda r: tuple((x is not None, x) for x in r)
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    b = sorted((tuple(map(plain, r)) for r in want.select(*cols).fetchall()), key=key)
    assert a == b and a
    kinds = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int", "HUGEINT": "?"}
    assert {c: kinds[str(t)] for c, t in zip(want.columns, want.types, strict=True)} == dict(df.dtypes)
