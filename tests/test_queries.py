"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tablekeep.plans.oracles import ORACLES
from tablekeep.plans.queries import QUERIES
from tablekeep.plans.star_catalogue import TABLES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def _plain(frame):
    names = sorted(frame.columns)

    def cell(value):
        if value is None or value != value:
            return None
        return round(value, 6) if isinstance(value, float) else str(value)

    return names, sorted(
        (tuple(cell(v) for v in row) for row in frame[names].itertuples(index=False)), key=repr
    )


def test_every_query_is_compared():
    assert set(QUERIES) - set(ORACLES) == {"ds_fingerprints"}
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, sql, name):
    mine = entry.queries()[name](spark, SF_DIR).toPandas()
    theirs = sql.execute(entry.oracle_sql()[name]).fetchdf()
    assert len(mine) == len(theirs)
    assert _plain(mine) == _plain(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 9


def test_fingerprints(spark):
    assert entry.queries()["ds_fingerprints"](spark, SF_DIR).count() == len(TABLES)
