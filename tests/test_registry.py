"""Registry contract: every oracle has a query, entry() runs, and a sample of
queries equals its SQL oracle on sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem events".split()
SAMPLE = ["scan_ratings_table", "filter_active_popular", "popularity_stats", "data_statistics", "top_genre_popular",
          "cold_start", "reco_statistics", "ks_drift", "detect_drift", "filter_sweep", "append_table", "rate_5m"]


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 100


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["item_id", "title", "num_ratings", "avg_rating", "popularity_score"]
    assert 0 < df.count() <= 10


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("key", SAMPLE)
def test_query_equals_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t + '.parquet')}')")
    df = E.queries()[key](spark, SF)
    cols = df.columns
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    drows = res.fetchall()
    idx = [dcols.index(c) for c in cols]
    assert _norm(tuple(r) for r in df.collect()) == _norm(tuple(r[i] for i in idx) for r in drows)
