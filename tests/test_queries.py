"""Every core query against its SQL in DuckDB, on the smallest tables, whole."""

import glob
import math
import os

import duckdb
import pytest

from cliplake.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(FOLDER + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return repr(x) if isinstance(x, float) else tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    r = duck.execute(SQL[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())
    assert got == want


def test_queries_without_sql(spark):
    assert set(QUERIES) - set(SQL) == {"p3_found", "wav_decode"}
    row = QUERIES["wav_decode"](spark, FOLDER).first()
    assert (row.rate, row.n_samples, list(row["head"])) == (16000, 100, [0.5] * 4)


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
