"""Every query against its SQL in DuckDB, at the smallest scale."""

import decimal
import glob
import os

import duckdb
import pytest

from smframe.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(row):
    return tuple("" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (float, decimal.Decimal)) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(catalogue.ORACLE[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == names
    rows = [tuple(r[order.index(c)] for c in names) for r in want.fetchall()]
    assert sorted(map(plain, df.select(names).collect())) == sorted(map(plain, rows))


@pytest.mark.parametrize("name", sorted({*catalogue.QUERIES} - {*catalogue.ORACLE}))
def test_runs_without_sql(spark, name):
    """Queries that SQL can't express give rows; their results are tested with their operators."""
    assert len(catalogue.QUERIES[name](spark, SF).collect()) > 0


def test_names_are_registered_once():
    assert sum(len(m.QUERIES) for m in catalogue.MODULES) == len(catalogue.QUERIES)
