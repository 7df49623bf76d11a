"""Recommender properties: exact top-N against brute force, no rated item,
ranks 1..N, model ordering on planted factors (F10)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelrank.operators import evaluate as E
from reelrank.operators import recommend as R


@pytest.fixture(scope="module")
def planted(spark):
    """60 users x 40 items, rating = clip(3 + u.v) rounded to 0.5, rank 2."""
    rng = np.random.default_rng(7)
    u = rng.normal(0, 1, (60, 2))
    v = rng.normal(0, 1, (40, 2))
    rows = []
    for i in range(60):
        for j in range(40):
            if rng.random() < 0.7:
                r = float(np.clip(np.round((3 + u[i] @ v[j]) * 2) / 2, 0.5, 5.0))
                rows.append((i, 100 + j, r, 1000 + i * 40 + j))
    df = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double, timestamp bigint")
    return df.withColumn("rating", F.col("rating").cast("decimal(2,1)"))


def test_f10_mf_and_knn_beat_random(planted):
    folds = E.cross_validate(planted, ("mf", "knn", "normal"), 3, 1,
                             mf_params={"rank": 2, "max_iter": 15, "reg": 0.05})
    means = {r.model: r.mean_rmse for r in E.cv_mean(folds).collect()}
    assert means["mf"] < means["normal"] and means["knn"] < means["normal"]
    assert E.best_of(E.cv_mean(folds)).first().best_model == "mf"


def test_topn_matches_brute_force(spark, planted):
    model = R.fit_mf(planted, rank=2, max_iter=5, seed=3)
    items = planted.select("item_id").distinct().withColumn("title", F.concat(F.lit("t"), F.col("item_id")))
    req = spark.createDataFrame([(0,), (5,), (59,), (12345,)], "user_id bigint")
    got = R.recommend_users(model, req, planted, items, 5).collect()
    # brute force with the same factors
    uf = {r.user_id: np.array(r.features) for r in model.user_factors.collect()}
    itf = {r.item_id: np.array(r.features) for r in model.item_factors.collect()}
    bu = {r.user_id: r.b_u for r in model.user_bias.collect()}
    bi = {r.item_id: r.b_i for r in model.item_bias.collect()}
    rated = {}
    for r in planted.select("user_id", "item_id").collect():
        rated.setdefault(r.user_id, set()).add(r.item_id)
    for user in (0, 5, 59):
        scores = sorted(((-min(5.0, max(0.5, model.mu + bu[user] + bi[i] + uf[user] @ itf[i])), i)
                         for i in itf if i not in rated[user]))
        expect = [i for _, i in scores[:5]]
        mine = [r.item_id for r in sorted((r for r in got if r.user_id == user), key=lambda r: r.rank)]
        assert mine == expect
        assert not set(mine) & rated[user]
        ranks = sorted(r.rank for r in got if r.user_id == user)
        assert ranks == list(range(1, len(ranks) + 1))
    assert not [r for r in got if r.user_id == 12345]


def test_topn_blocks_equal_single_block(spark, planted, monkeypatch):
    model = R.fit_mf(planted, rank=2, max_iter=5, seed=3)
    items = planted.select("item_id").distinct().withColumn("title", F.lit("t"))
    req = planted.select("user_id").distinct()
    one = {(r.user_id, r.rank, r.item_id) for r in R.recommend_users(model, req, planted, items, 5).collect()}
    monkeypatch.setattr(R, "USERS_PER_CHUNK", 7)
    monkeypatch.setattr(R, "ITEMS_PER_BLOCK", 9)
    many = {(r.user_id, r.rank, r.item_id) for r in R.recommend_users(model, req, planted, items, 5).collect()}
    assert one == many


def test_topn_bounds_skip_blocks_and_keep_ties(spark, monkeypatch):
    """Items of steeply falling bias: users need few of the blocks. Scores clipped at 5.0 tie and go to the smaller id."""
    users, items = 40, 400
    uf = spark.createDataFrame([(u, [0.1 * (u % 3), 0.1]) for u in range(users)], "user_id long, features array<double>")
    itf = spark.createDataFrame([(i, [0.1 * (i % 5), -0.1]) for i in range(items)], "item_id long, features array<double>")
    bu = spark.createDataFrame([(u, 0.0) for u in range(users)], "user_id long, b_u double")
    bi = spark.createDataFrame([(i, 3.0 if 100 <= i < 108 else -i / 200) for i in range(items)], "item_id long, b_i double")
    model = R.MFModel(3.0, bu, bi, uf, itf, 2)
    rated = spark.createDataFrame([(u, i) for u in range(users) for i in (100 + u % 8, u)], "user_id long, item_id long")
    monkeypatch.setattr(R, "ITEMS_PER_BLOCK", 10)
    monkeypatch.setattr(R, "USERS_PER_CHUNK", 9)
    top, pairs = R.top_items(model, bu.select("user_id"), rated, 5)
    got = {}
    for r in top.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(r.item_id)
    assert got == {u: [i for i in range(100, 108) if i != 100 + u % 8][:5] for u in range(users)}
    scored = pairs.count()
    assert users <= scored < users * items / 10 / 4  # fewer than a quarter of all user-block pairs


def test_ids_beyond_int(spark, planted):
    big = planted.withColumn("user_id", F.col("user_id") + 3_000_000_000).withColumn("item_id", F.col("item_id") + 5_000_000_000)
    small, large = R.fit_mf(planted, rank=2, max_iter=3, seed=1), R.fit_mf(big, rank=2, max_iter=3, seed=1)
    pairs = planted.select("user_id", "item_id").limit(50)
    a = {(r.user_id, r.item_id): r.est for r in R.predict_pairs(small, pairs).collect()}
    b = {(r.user_id - 3_000_000_000, r.item_id - 5_000_000_000): r.est for r in R.predict_pairs(
        large, pairs.select((F.col("user_id") + 3_000_000_000).alias("user_id"), (F.col("item_id") + 5_000_000_000).alias("item_id"))).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-3) for k in a)


def test_item_blocks_leave_the_model(planted, monkeypatch):
    """Users' factors go to fewer blocks than the starting factors are drawn in, and the model is the one of equal blocks."""
    made, als = [], R.ALS

    def note(**kw):
        made.append((kw["numUserBlocks"], kw["numItemBlocks"]))
        return als(**kw)

    def factors(m):
        return [sorted((r[0], tuple(r.features)) for r in f.collect()) for f in (m.user_factors, m.item_factors)]

    monkeypatch.setattr(R, "ALS", note)
    now = factors(R.fit_mf(planted, rank=2, max_iter=3, seed=1))
    assert made == [(R.ALS_BLOCKS, R.ALS_ITEM_BLOCKS)] and R.ALS_ITEM_BLOCKS < R.ALS_BLOCKS
    monkeypatch.setattr(R, "ALS", lambda **kw: als(**(kw | {"numItemBlocks": kw["numUserBlocks"]})))
    for a, b in zip(now, factors(R.fit_mf(planted, rank=2, max_iter=3, seed=1))):
        assert [x for x, _ in a] == [x for x, _ in b] and np.allclose([f for _, f in a], [f for _, f in b], rtol=1e-5, atol=1e-6)


def test_top_n_bounds(spark, planted):
    model = R.fit_mf(planted, rank=2, max_iter=2)
    with pytest.raises(ValueError):
        R.recommend_users(model, planted.select("user_id"), planted, planted, 0)


def test_predict_pairs_fallback(spark, planted):
    model = R.fit_mf(planted, rank=2, max_iter=3)
    pairs = spark.createDataFrame([(0, 100), (999, 100), (999, 999)], "user_id bigint, item_id bigint")
    est = {(r.user_id, r.item_id): r.est for r in R.predict_pairs(model, pairs).collect()}
    assert est[(999, 999)] == pytest.approx(model.mu)
    assert 0.5 <= est[(0, 100)] <= 5.0


def _knn_brute(train_rows, queries, k, mu):
    by_user = {}
    for u, i, r in train_rows:
        by_user.setdefault(u, {})[i] = r
    out = {}
    for u, i in queries:
        cands = []
        for v, items in by_user.items():
            if v == u or i not in items:
                continue
            common = set(by_user.get(u, {})) & set(items)
            if not common:
                continue
            msd = sum((by_user[u][j] - items[j]) ** 2 for j in common) / len(common)
            cands.append((-(1 / (1 + msd)), v, items[i]))
        top = sorted(cands)[:k]
        if top:
            est = sum(-s * r for s, _, r in top) / sum(-s for s, _, _ in top)
        else:
            est = mu
        out[(u, i)] = min(5.0, max(0.5, est))
    return out


def test_knn_matches_brute_force(spark, planted, monkeypatch):
    from reelrank.operators import knn as K
    from reelrank.operators.joins import salted_join
    train = planted.filter("timestamp % 3 != 0")
    test = planted.filter("timestamp % 3 = 0").select("user_id", "item_id")
    extra = spark.createDataFrame([(12345, 100), (0, 99999)], "user_id bigint, item_id bigint")
    q = test.unionByName(extra)
    rows = [(r.user_id, r.item_id, float(r.rating)) for r in train.collect()]
    monkeypatch.setattr(K, "salted_join", lambda a, b, key: salted_join(a, b, key, 7))  # every item is hot
    model = K.fit_knn(train, k=5)
    got = {(r.user_id, r.item_id): r.est for r in K.predict_knn(model, q).collect()}
    want = _knn_brute(rows, [(r.user_id, r.item_id) for r in q.collect()], 5, model.mu)
    assert set(got) == set(want)
    for key, v in want.items():
        assert got[key] == pytest.approx(v, abs=1e-9), key


def test_all_folds_in_one_pass_equal_single_fits(spark, planted):
    from reelrank.operators import knn as K
    from reelrank.operators.sampling import kfold
    data = kfold(planted.select("user_id", "item_id", F.col("rating").cast("double").alias("rating")), ["user_id", "item_id"], 3, 5).cache()
    knn = {(r.user_id, r.item_id): r.est for r in K.predict_folds(data, 3, 5).collect()}
    rated = data.withColumnRenamed("rating", "r")
    bias = {(r.user_id, r.item_id): r.est for r in E.bias_folds(rated, 3).collect()}
    normal = {(r.user_id, r.item_id): r.est for r in E.normal_folds(rated, 3, 9).collect()}
    assert len(knn) == len(bias) == len(normal) == data.count()
    none = spark.createDataFrame([], "user_id long, features array<double>")
    for f in range(3):
        train, test = data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)
        for r in K.predict_knn(K.fit_knn(train, 5), test).collect():
            assert knn[(r.user_id, r.item_id)] == pytest.approx(r.est, abs=1e-9)
        model = R.MFModel(*R.fit_biases(train, *E.BIAS_REG), none, none.withColumnRenamed("user_id", "item_id"), 0)
        for r in R.predict_pairs(model, test).collect():
            assert bias[(r.user_id, r.item_id)] == pytest.approx(r.est, abs=1e-9)
        for r in R.predict_normal(R.fit_normal(train), test, 9).collect():
            assert normal[(r.user_id, r.item_id)] == pytest.approx(r.est, abs=1e-9)


@pytest.mark.parametrize("kind", ["knn", "normal", "mf", "bias"])
def test_any_winner_is_saved_and_predicts_the_same(spark, tmp_path, kind):
    from reelrank.operators import evaluate as E
    from reelrank.operators import knn as K
    from reelrank.operators import recommend as R
    rows = [(u, i, float((u * i) % 9 + 1) / 2) for u in range(12) for i in range(10) if (u + i) % 3]
    train = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    E.save_winner(kind, train, str(tmp_path / "w"), 3)
    name, model = E.load_winner(spark, str(tmp_path / "w"))
    assert name == kind
    pairs = train.select("user_id", "item_id", "rating")
    got = {(r.user_id, r.item_id): r.est for r in E.predict_with(kind, model, pairs, 3).collect()}
    none = spark.createDataFrame([], "user_id long, features array<double>")
    bias = lambda t: R.MFModel(*R.fit_biases(t, *E.BIAS_REG), none, none.withColumnRenamed("user_id", "item_id"), 0)
    fresh = {"knn": K.fit_knn, "normal": R.fit_normal, "mf": lambda t: R.fit_mf(t, seed=3), "bias": bias}[kind](train)
    want = {(r.user_id, r.item_id): r.est for r in E.predict_with(kind, fresh, pairs, 3).collect()}
    assert len(got) == len(rows) and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_knn_sends_raters_once_per_chunk_not_once_per_pair(spark, monkeypatch):
    """Every user rated every item: 80 * 79 pairs of users meet on 12 items. No step holds a row per pair, chunks and steps of
    any size give the same estimates, and a user without common items or an unrated item gets the mean."""
    from reelrank.operators import knn as K
    rows = [(u, i, float((u * 7 + i * 3) % 9 + 1) / 2) for u in range(80) for i in range(12)] + [(500, 900, 2.0)]
    train = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    queries = [(u, i) for u in range(0, 80, 9) for i in (0, 5, 11)] + [(500, 900), (3, 77), (7777, 0)]
    pairs = spark.createDataFrame(queries, "user_id long, item_id long")
    model = K.fit_knn(train, k=6)
    want = _knn_brute(rows, queries, 6, model.mu)
    for chunk, step in ((2_000_000, 4_000_000), (2_000, 50)):
        monkeypatch.setattr(K, "RATERS_PER_CHUNK", chunk)
        monkeypatch.setattr(K, "RATERS_PER_STEP", step)
        got = {(r.user_id, r.item_id): r.est for r in K.predict_knn(model, pairs).collect()}
        assert set(got) == set(want)
        assert all(got[key] == pytest.approx(v, abs=1e-9) for key, v in want.items())
    monkeypatch.undo()
    rated = train.withColumnRenamed("rating", "r").withColumn("fold", F.lit(0))
    v, r = np.arange(50_000) * 11, np.arange(50_000) % 10 / 2.0
    sent = K._packed(np.full(50_000, 7), v, r, np.zeros(50_000, np.int64))
    assert len(sent) < 4 * 50_000
    back = K._unpacked(50_000, sent)
    assert (back[0] == 7).all() and (back[1] == v).all() and (back[2] == r).all() and not back[3].any()
    plan = K._estimates(rated.withColumn("q_fold", F.lit(1)), rated, 6, 1)._jdf.queryExecution().analyzed().toString()
    assert "FlatMapCoGroups" in plan and "Window" not in plan


def test_topn_of_clipped_and_coarse_scores_needs_few_blocks(spark, monkeypatch):
    """Factors and biases in eighths, many scores clipped at 5.0: exact lists, and most user-block pairs are ruled out."""
    rng = np.random.default_rng(3)
    users, items = 60, 3000
    p, q = rng.integers(-8, 9, (users, 3)) / 8.0, rng.integers(-8, 9, (items, 3)) / 8.0
    bu, bi = rng.integers(-4, 5, users) / 8.0, rng.integers(-4, 5, items) / 8.0
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    model = R.MFModel(3.5, frame([(u, float(bu[u])) for u in range(users)], "user_id long, b_u double"),
                      frame([(i, float(bi[i])) for i in range(items)], "item_id long, b_i double"),
                      frame([(u, p[u].tolist()) for u in range(users)], "user_id long, features array<double>"),
                      frame([(i, q[i].tolist()) for i in range(items)], "item_id long, features array<double>"), 3)
    seen = {(u, int(i)) for u in range(users) for i in rng.integers(0, items, 40)} | {(0, i) for i in range(2990)}
    rated = frame(sorted(seen), "user_id long, item_id long")
    monkeypatch.setattr(R, "ITEMS_PER_BLOCK", 50)
    monkeypatch.setattr(R, "USERS_PER_CHUNK", 20)
    top, pairs = R.top_items(model, model.user_bias.select("user_id"), rated, 5)
    got = {}
    for r in top.orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append((r.item_id, r.score))
    score = np.clip(3.5 + bu[:, None] + bi[None, :] + p @ q.T, 0.5, 5.0)
    for u in range(users):
        want = sorted((-score[u, i], i) for i in range(items) if (u, i) not in seen)[:5]
        assert got[u] == [(i, -s) for s, i in want], u
    assert pairs.count() == pairs.distinct().count()
    assert pairs.filter("user_id > 0").count() < 59 * items / 50 / 3
