"""Every registered query against its SQL on the smallest data set."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracle_sql():
        assert mine[1]
        return
    cur = con.execute(oracle_sql()[name])
    assert mine == canonical([d[0] for d in cur.description], cur.fetchall())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
