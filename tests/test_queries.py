"""Every query next to its SQL on the smallest tables; the rest must return rows."""

import pytest

import __spark_entry__ as entry
from check import compare, duck, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# model fits take their time; they have tests of their own
SLOW = {n for n in QUERIES if n.startswith(("m03", "m04", "m05", "m06", "m07"))}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert got[1]
        return
    cur = con.execute(ORACLES[name])
    assert compare(got, rows_of([d[0] for d in cur.description], cur.fetchall())) == "ok"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
