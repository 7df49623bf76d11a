"""What keeps memory and traffic of the large queries from growing faster than their input."""

import os
import re
from contextlib import contextmanager
from datetime import datetime
from types import SimpleNamespace

from reelrank.operators import analytics as A
from reelrank.operators import recommend as R
from reelrank.plans import catalog, streams
from reelrank.sources.driver import DriverModel

RATED = [(1, 10, 4.0), (1, 11, 2.0), (1, 10, 3.0), (2, 11, 5.0), (None, 10, 1.0), (3, 99, 5.0), (2, 12, None)]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@contextmanager
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def test_per_user_limit_sorts_once(spark):
    ratings = spark.createDataFrame([(u, i, float(i % 5), i) for u in (1, 2, None) for i in range(8)], "user_id long, item_id long, rating double, timestamp long")
    got = catalog.topn_per_user(SimpleNamespace(ratings=lambda: ratings))
    assert len(re.findall(r"\bSort \[", plan(got))) == 1
    rows = sorted((r.rank, r.item_id) for r in got.collect() if r.user_id == 1)
    assert rows == [(1, 4), (2, 3), (3, 7), (4, 2), (5, 6)]


def test_ratings_are_sorted_once(spark, tmp_path):
    day = datetime(1995, 1, 2)
    tables = {
        "lineitem": spark.createDataFrame([(1, 7, 1, 1, 50.0), (2, 7, 1, 1, 5.0), (2, 8, 1, 2, 20.0), (None, 9, 1, 1, 5.0)],
                                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"),
        "orders": spark.createDataFrame([(1, 3, day), (2, 3, day), (5, 4, day)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")}
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    with no_broadcast(spark):
        got = DriverModel(spark, str(tmp_path), store=False).derive_ratings()
        assert len(re.findall(r"\bSort \[", plan(got))) == 1
        assert {(r.user_id, r.item_id, float(r.rating)) for r in got.collect()} == {(3, 7, 0.5), (3, 8, 2.0)}


def test_user_genres_move_ratings_not_their_genres(spark):
    ratings = spark.createDataFrame(RATED, "user_id long, item_id long, rating double")
    item_genres = spark.createDataFrame([(10, 1), (10, 2), (10, 2), (11, 1), (11, 3), (12, 1), (13, 1)], "item_id long, genre_id long")
    genres = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "genre_id long, name string")
    got = A.preferred_genres(ratings, item_genres, genres)
    assert not re.search(r"hashpartitioning\(user_id#\d+L?, genre", plan(got))
    assert {(r.user_id, r.genre, r.avg_rating, r.num_ratings) for r in got.collect()} == {
        (1, "a", 3.0, 3), (1, "b", 3.5, 4), (1, None, 2.0, 1), (2, "a", 5.0, 1), (2, None, 5.0, 1), (None, "a", 1.0, 1), (None, "b", 1.0, 2)}


def test_predicted_pairs_are_not_sorted(spark):
    bias = lambda k, n, rows: spark.createDataFrame(rows, f"{k} long, {n} double")
    factors = lambda k, rows: spark.createDataFrame(rows, f"{k} long, features array<double>")
    model = R.MFModel(3.0, bias("user_id", "b_u", [(1, 0.5)]), bias("item_id", "b_i", [(7, 0.25)]), factors("user_id", [(1, [1.0, 2.0])]), factors("item_id", [(7, [0.5, 0.25])]), 2)
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (None, None)], "user_id long, item_id long")
    with no_broadcast(spark):
        got = R.predict_pairs(model, pairs)
        assert not re.search(r"\bSort \[", plan(got))
        assert {(r.user_id, r.item_id): r.est for r in got.collect()} == {(1, 7): 4.75, (1, 8): 3.5, (2, 7): 3.25, (None, None): 3.0}


def test_years_are_read_from_their_own_folders(spark, monkeypatch):
    made, rows = {}, []

    def scratch(session, name, real=streams.scratch_path):
        made[name] = real(session, name)
        return made[name]

    lines = [(1, 7, 1994), (1, 8, 1995), (2, 7, 1995), (3, 9, None)]
    monkeypatch.setattr(streams, "scratch_path", scratch)
    monkeypatch.setattr(streams, "_line_ratings", lambda m: spark.createDataFrame(lines, "user_id long, item_id long, year int"))
    streams._run_by_year(SimpleNamespace(spark=spark), "t-years", lambda batch, _: rows.append(sorted(map(tuple, batch.collect()))))
    folder = made["t-years-lines"].removeprefix("file:")
    assert {"year=1994", "year=1995"} <= set(os.listdir(folder))
    assert [r for r in rows if r] == [[(1, 7, 1994)], [(1, 8, 1995), (2, 7, 1995)]]


def test_lists_move_ratings_of_the_asked_blocks_only(spark, monkeypatch):
    """One block of items beats all others but the one of the smallest ids: ratings in the rest never meet the users."""
    users, items = 6, 80
    frame = spark.createDataFrame
    model = R.MFModel(3.0, frame([(u, 0.0) for u in range(users)], "user_id long, b_u double"),
                      frame([(i, 1.0 if i >= 70 else -i / 100) for i in range(items)], "item_id long, b_i double"),
                      frame([(u, [0.0]) for u in range(users)], "user_id long, features array<double>"),
                      frame([(i, [0.0]) for i in range(items)], "item_id long, features array<double>"), 1)
    ratings = frame([(u, i) for u in range(users) for i in range(0, items, 2)] + [(None, 71), (99, 72), (1, None), (1, 70)], "user_id long, item_id long")
    moved, score = [], R.score_blocks

    def spy(asked, rated, *rest):
        moved.append((rated.count(), rated.join(asked.select("block").distinct(), "block", "left_anti").count()))
        return score(asked, rated, *rest)

    monkeypatch.setattr(R, "ITEMS_PER_BLOCK", 10)
    monkeypatch.setattr(R, "score_blocks", spy)
    top, _ = R.top_items(model, model.user_bias.select("user_id"), ratings, 5)
    got = {}
    for r in top.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.item_id)
    assert got == {u: [71, 73, 75, 77, 79] for u in range(users)}
    assert all(n < ratings.count() / 2 and not other for n, other in moved)


def test_the_fit_reads_residuals_that_are_stored(spark, monkeypatch):
    """ALS runs the plan of its input more than once: it holds no join. Ratings without an id or a value count as before."""
    rows = [(u, i, float(1 + (u * i) % 5)) for u in range(8) for i in range(6)] + [(None, 2, 4.0), (3, None, 2.0), (4, 5, None)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    plans, fit = [], R.ALS.fit

    def spy(self, data, *rest):
        plans.append(plan(data))
        return fit(self, data, *rest)

    monkeypatch.setattr(R.ALS, "fit", spy)
    some = ratings.filter("rating is not null")
    model = R.fit_mf(some, rank=2, max_iter=2, seed=1)
    assert len(plans) == 1 and not re.search("Join|Exchange", plans[0])
    mu, user_bias, item_bias = R.fit_biases(ratings)
    kept = lambda df, k, v: {r[k]: round(r[v], 9) for r in df.collect()}
    mu2, user_bias2, item_bias2 = R.fit_biases(some)
    assert model.mu == mu2 and kept(model.user_bias, "user_id", "b_u") == kept(user_bias2, "user_id", "b_u")
    assert kept(model.item_bias, "item_id", "b_i") == kept(item_bias2, "item_id", "b_i")
    seen = [r for r in rows if r[1] == 0]
    assert kept(item_bias, "item_id", "b_i")[0] == round((sum(r[2] for r in seen) - len(seen) * mu) / (len(seen) + 10), 9)
    assert {r.user_id for r in model.user_factors.collect()} == set(range(8))
