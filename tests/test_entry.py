"""The driver contract: entry, queries and their SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_module
from ohlcraft.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_names():
    assert set(QUERIES) <= set(entry_module.queries()) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", ["bars_day", "rps_rank_63", "signed_run_up", "market_breadth", "macd", "asof_major_minor", "dedup_latest", "chan_strokes", "chan_pivots", "trade_ledger", "market_vote"])
def test_sql_agrees(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    sql = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(sql.columns) and len(got) == len(sql)
    keys = sorted(got.columns)

    def text(df):
        return sorted(tuple("" if x is None or x != x else str(x) for x in row) for row in df[keys].itertuples(index=False))

    assert text(got) == text(sql)


@pytest.mark.parametrize("name", ["cov_matrix", "densify_fill", "display_text", "range_between"])
def test_every_symbol(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    got, sql = QUERIES[name](spark, sf).toPandas(), con.sql(ORACLES[name]).df()
    keys = ["a", "b"] if name == "cov_matrix" else [c for c in ("symbol", "dt", "t1", "t2") if c in got]
    assert got[keys[0]].nunique() == 100 and len(got) == len(sql)
    got, sql = (df[sorted(df.columns)].sort_values(keys).reset_index(drop=True) for df in (got, sql))
    for c in got:
        if got[c].dtype.kind == "f":
            assert np.allclose(got[c], sql[c].astype(float), atol=2e-3, equal_nan=True)
        else:
            assert (got[c].astype(str) == sql[c].astype(str)).all()


def test_markowitz_takes_every_symbol(spark):
    got = QUERIES["markowitz"](spark, SF).collect()
    assert sorted(x.symbol for x in got) == [x[0] for x in duckdb.sql(f"select distinct l_suppkey from '{SF}/lineitem.parquet' order by 1").fetchall()]
    assert abs(sum(x.min_variance for x in got) - 1) < 0.01
