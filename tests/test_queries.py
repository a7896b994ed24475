"""Every query of the library against its SQL on the same small tables."""

import math
import os

import duckdb
import pytest

from tracefold import plans as library
from tracefold.plans import filings, measures, pages, texts  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_same_rows_as_sql(name, spark, sql):
    df = library.QUERIES[name](spark, SF)
    want = sql.sql(library.SQL[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(c) for c in names]
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_query_without_sql_runs(spark):
    for name in set(library.QUERIES) - set(library.SQL):
        assert library.QUERIES[name](spark, SF).count() >= 0
