"""Operators that SQL can express, against their SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tablekeep.llm.oracles import ORACLES
from tablekeep.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{file}'")
    theirs = connection.execute(ORACLES[name]).fetchdf()
    mine = QUERIES[name](spark, SF_DIR).toPandas()
    columns = sorted(theirs.columns)
    assert sorted(mine.columns) == columns

    def text(value):
        # pandas holds whole numbers beside nulls as floats
        return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)

    def plain(frame):
        rows = (tuple(None if pd.isna(v) else text(v) for v in row) for row in frame[columns].itertuples(index=False))
        return sorted(rows, key=str)

    assert plain(mine) == plain(theirs)
