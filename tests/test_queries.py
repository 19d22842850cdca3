"""Every registered query at sf0.001 against its DuckDB oracle (or rows-only)."""

import pytest

import __spark_entry__ as entry
from tools.oracle_check import digest

QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(small_dir):
    import duckdb
    from evalforge.plans.tables import TABLES
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1 and "avg_improvement" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, small_dir, name):
    df = QUERIES[name](spark, small_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert df.columns
        return
    cur = duck.execute(ORACLE[name])
    drows = cur.fetchall()
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(dcols, drows)[0]
