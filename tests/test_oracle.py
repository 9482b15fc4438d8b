"""Every registered query with a SQL oracle, on the smallest tables, against
DuckDB (row multiset after rounding)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from styleframe.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
SLOW = {"lexical_lr"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    pdf = E.queries()[name](spark, SF).toPandas()
    odf = con.execute(E.oracle_sql()[name]).df()
    assert _rows(pdf) == _rows(odf)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) == {"lang", "split", "n_users", "n_comments", "n_sentences"}


def test_every_query_runs(spark):
    for name, fn in E.queries().items():
        if name in SLOW:
            continue
        assert fn(spark, SF).count() >= 0
