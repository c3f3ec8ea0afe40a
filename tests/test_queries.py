"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from treeloom.plans import queries as plain


def rows(pdf, cols):
    pdf = pdf[cols].astype(object)
    return sorted(map(repr, pdf.where(pdf.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plain.ORACLE_SQL))
def test_oracle(spark, duck, small, name):
    mine = entry_points.queries()[name](spark, small).toPandas()
    theirs = duck.execute(plain.ORACLE_SQL[name]).df()
    cols = sorted(theirs.columns)
    assert sorted(mine.columns) == cols
    assert rows(mine, cols) == rows(theirs, cols)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 50
