"""Every registered query against its SQL twin on the smallest test data."""

import signal

import pytest
from check import duck, plain, table

from __spark_entry__ import entry, oracle_sql, queries
from wayfold.catalog.registry import QUERIES, TWINS

FOLDER = "/root/testdata/sf0.001"
ALL, ALL_TWINS = queries(), oracle_sql()  # this also fills QUERIES and TWINS


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_twin_has_a_query():
    assert set(ALL_TWINS) <= set(ALL)
    assert len(QUERIES) == 137
    assert set(QUERIES) <= set(ALL)


@pytest.fixture
def limited(spark):
    """A query over the limit fails by itself and does not hide the others."""

    def stop(*_):
        spark.sparkContext.cancelAllJobs()
        raise TimeoutError("over 300 seconds")

    signal.signal(signal.SIGALRM, stop)
    signal.alarm(300)
    yield
    signal.alarm(0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, limited):
    df = QUERIES[name](spark, FOLDER)
    mine, names = table([tuple(r) for r in df.collect()], df.columns)
    if name not in TWINS:
        assert mine
        return
    cur = con.execute(TWINS[name])
    theirs, other = table(cur.fetchall(), [d[0] for d in cur.description])
    assert names == other
    assert mine == theirs


def test_entry(spark):
    assert entry(spark).count() > 0


def test_plain_forms():
    assert plain(float("nan")) is None
    assert plain([1, None]) == (1, None)
