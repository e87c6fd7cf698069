"""Every registered query against its independent DuckDB formulation (sf0.001)."""

import math
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from vacfleet.plans import catalog, oracle

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    pdf = pdf[cols].astype(object).where(pd.notna(pdf[cols]), None)
    return cols, Counter(tuple(_norm(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = E.queries()[name](spark, SF).toPandas()
    want = con.execute(E.oracle_sql()[name]).df()
    gc, gr = _rows(got)
    wc, wr = _rows(want)
    assert gc == wc
    assert gr == wr, (list((gr - wr).items())[:3], list((wr - gr).items())[:3])


def test_every_query_has_an_oracle():
    """All queries of the control and experiment operators; the corpus operators that SQL
    cannot express are tested against brute force in their own folder."""
    assert set(catalog.QUERIES) <= set(E.queries())
    assert set(catalog.QUERIES) == set(oracle.ORACLE)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "vacuum_debt_ratio" in df.columns
