"""Registered recommender queries (R1-R12, A16, A25, A26, T10, log_run,
save_model, load_model, write_topn_csv).

Fits of the factorisation depend on the optimiser and are checked on rows and
schema. Everything else has a SQL oracle: top-N lists, pair predictions,
routing and the model store run on a stated factor table (`_fixed_model`,
drawn from id hashes over all users and items, so the same numbers arise in
SQL); bias, kNN and normal models are cross-validated on keyed folds; the run
history is derived from the ratings, period by period.

Training data is J1 (thresholds 30/25) over the full ratings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reelrank.config import JobConfig
from reelrank.functions.columns import hash_order
from reelrank.operators import analytics as A
from reelrank.operators import evaluate as E
from reelrank.operators import knn as K
from reelrank.operators import recommend as R
from reelrank.operators import runs as RU
from reelrank.operators.sampling import kfold
from reelrank.plans.catalog import _COLD_SQL, MIN_ITEM, MIN_USER, UNKNOWN_USER, _hash_sql, _requested_users, register
from reelrank.session import scratch_path, stored
from reelrank.sinks import writers as W

# Parameters of the registered queries. mf_reg: the driver ratings are noise, where 3-fold CV prefers 0.5 to the default.
CONFIG = JobConfig().with_overrides(min_ratings_user=MIN_USER, min_ratings_movie=MIN_ITEM, mf_reg=0.5)
TOP_N = CONFIG.top_n
SEED = CONFIG.predict_seed


def _train(m):
    return A.filter_active_popular(m.ratings(), CONFIG.min_ratings_user, CONFIG.min_ratings_movie)


def _fit(m):
    return R.fit_mf(_train(m), seed=SEED, **CONFIG.mf_params())


# The stated factor table: RANK factors and a bias in eighths, drawn from the id's hash, so that every score is a multiple of
# 1/64 (exact in any engine, with many ties). One user in SKIP is not in the model and gets the cold-start fallback.
RANK, SKIP, FIXED_MU = 4, 50, 3.0


def _fixed_model(m) -> R.MFModel:
    def table(ids, key, name, seed):
        bias = ((hash_order([key], seed) % 9) - 4) / 8.0
        features = F.array(*[((hash_order([key], seed + 1 + k) % 17) - 8) / 8.0 for k in range(RANK)])
        return ids.select(key, bias.alias(name)), ids.select(key, features.alias("features"))

    b_u, p = table(m.users().filter(F.col("user_id") % SKIP != 0), "user_id", "b_u", 100)
    b_i, q = table(m.items().select("item_id"), "item_id", "b_i", 200)
    return R.MFModel(FIXED_MU, b_u, b_i, p, q, RANK)


def _fixed_sql(ids: str, key: str, name: str, seed: int) -> str:
    draw = ", ".join(f"({_hash_sql(key, seed + 1 + k)} % 17 - 8) / 8.0::DOUBLE AS {name}{k}" for k in range(RANK))
    return f"SELECT {key}, ({_hash_sql(key, seed)} % 9 - 4) / 8.0::DOUBLE AS b_{name}, {draw} FROM {ids}"


_SCORE = "greatest(0.5, least(5.0, {mu} + {bu} + {bi} + {dot}))"
_FIXED_SQL = f"""
, fu AS MATERIALIZED ({_fixed_sql(f"(SELECT user_id FROM users WHERE user_id % {SKIP} <> 0) x", "user_id", "u", 100)}),
  fi AS MATERIALIZED ({_fixed_sql("items", "item_id", "i", 200)})
"""
_LISTS_SQL = _FIXED_SQL + f"""
, scored AS (SELECT user_id, item_id, {_SCORE.format(mu=FIXED_MU, bu="b_u", bi="b_i", dot=" + ".join(f"u{k} * i{k}" for k in range(RANK)))} AS score FROM fu, fi),
  lists AS (SELECT t.user_id, CAST(t.rank AS INTEGER) AS rank, t.item_id, i.title AS movie, t.score FROM (
    SELECT s.*, row_number() OVER (PARTITION BY s.user_id ORDER BY s.score DESC, s.item_id) AS rank FROM scored s
    WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = s.user_id AND r.item_id = s.item_id)) t JOIN items i USING (item_id) WHERE t.rank <= {TOP_N})
"""


def _lists(m):
    """R8 on the stated factor table, for every user and an unknown id."""
    return R.recommend_users(_fixed_model(m), _requested_users(m), m.ratings(), m.items(), TOP_N)


PROVABLE = ("bias", "knn", "normal")


def _folds(m):
    """The metrics of 3-fold CV of the bias-only, kNN and normal models on the training ratings, stored as a table once per
    application and input."""
    from reelrank.sources.driver import _write
    return m._stored("cv-metrics", ["lineitem", "orders"], lambda: E.cross_validate(_train(m), PROVABLE, CONFIG.cv_folds, SEED), _write)


def _history(m):
    """The run table: runs derived from the ratings, one training and one prediction run per year, appended twice (the
    second call adds nothing) and read back."""
    path = scratch_path(m.spark, "runs")
    runs = stored(RU.period_runs(m.ratings(), F.year(F.timestamp_seconds("timestamp"))), "period-runs")
    RU.log_runs(runs, path)
    RU.log_runs(runs, path)
    return path


@register("fit_mf")
def fit_mf(m):
    """Biases + ALS on residuals; one row per item with its bias and factor norm."""
    model = _fit(m)
    f = model.item_factors.select("item_id", F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)).alias("q_norm"))
    return model.item_bias.join(f, "item_id").withColumn("mu", F.lit(model.mu))


_TRAIN_SQL = f"""
, train AS (SELECT r.* FROM ratings r
    WHERE r.user_id IN (SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) >= {MIN_USER})
      AND r.item_id IN (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) >= {MIN_ITEM}))
"""


_FOLD_SQL = _TRAIN_SQL + f"""
, t AS MATERIALIZED (SELECT user_id, item_id, rating AS r, CAST({_hash_sql('user_id, item_id', SEED)} % {CONFIG.cv_folds} AS INTEGER) AS fold FROM train),
  f AS (SELECT fold, count(*) AS n, sum(r) AS s, sum(r * r) AS ss FROM t GROUP BY fold),
  fm AS MATERIALIZED (SELECT fold, (sum(s) OVER () - s) / (sum(n) OVER () - n) AS mu, (sum(ss) OVER () - ss) / (sum(n) OVER () - n) AS m2 FROM f),
  cand AS (SELECT q.user_id, q.item_id, q.fold, v.user_id AS v, v.r FROM t q JOIN t v ON q.item_id = v.item_id AND q.user_id <> v.user_id AND q.fold <> v.fold),
  co AS (SELECT a.user_id, b.user_id AS v, g.fold, count(*) AS c, sum((a.r - b.r) * (a.r - b.r)) AS s FROM t a JOIN t b ON a.item_id = b.item_id AND a.user_id <> b.user_id
         JOIN (SELECT DISTINCT fold FROM t) g ON a.fold <> g.fold AND b.fold <> g.fold GROUP BY 1, 2, 3),
  near AS (SELECT cand.*, 1.0 / (1.0 + s / c) AS sim FROM cand JOIN co USING (user_id, v, fold)),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY sim DESC, v) AS rn FROM near) x WHERE rn <= {K.DEFAULT_K}),
  knn AS (SELECT user_id, item_id, sum(sim * r) / sum(sim) AS e FROM best GROUP BY 1, 2),
  knn_est AS (SELECT t.*, greatest(0.5, least(5.0, coalesce(knn.e, fm.mu))) AS est FROM t JOIN fm USING (fold) LEFT JOIN knn USING (user_id, item_id))
"""


@register("fit_knn", _FOLD_SQL + "SELECT user_id, item_id, r AS rating, round(est, 6) AS est FROM knn_est WHERE fold = 0")
def fit_knn(m):
    """R2: user kNN (MSD similarity, k = 40) predictions for one held-out fold."""
    data = stored(kfold(_train(m).select("user_id", "item_id", "rating"), ["user_id", "item_id"], CONFIG.cv_folds, SEED), "knn-folds")
    train = data.filter("fold != 0").drop("fold")
    test = data.filter("fold = 0").drop("fold")
    return K.predict_knn(K.fit_knn(train), test).withColumn("est", F.round("est", 6))


@register("fit_normal", _TRAIN_SQL + f"""
, s AS (SELECT avg(rating) AS mu, stddev_pop(rating) AS sigma FROM train),
  d AS (SELECT user_id, item_id, rating, ({_hash_sql('user_id, item_id', SEED)} + 1) / 1152921504606846976.0::DOUBLE AS u,
               {_hash_sql('user_id, item_id', SEED + 1)} / 1152921504606846976.0::DOUBLE AS v FROM train)
SELECT user_id, item_id, rating, round(greatest(0.5, least(5.0, sqrt(-2 * ln(u)) * cos(2 * pi() * v) * sigma + mu)), 6) AS est FROM d, s""")
def fit_normal(m):
    """Mean and deviation of the training ratings, with the predictions of its own pairs."""
    nm = R.fit_normal(_train(m))
    out = R.predict_normal(nm, _train(m).select("user_id", "item_id", "rating"), SEED)
    return out.withColumn("est", F.round("est", 6))


_PAIRS_SQL = _TRAIN_SQL + _FIXED_SQL + f"""
, pairs AS (SELECT user_id, item_id, rating FROM train UNION ALL SELECT {UNKNOWN_USER}, item_id, NULL FROM items)
SELECT p.user_id, p.item_id, p.rating, {_SCORE.format(mu=FIXED_MU, bu="coalesce(b_u, 0.0)", bi="coalesce(b_i, 0.0)", dot="coalesce(" + " + ".join(f"u{k} * i{k}" for k in range(RANK)) + ", 0.0)")} AS est
FROM pairs p LEFT JOIN fu USING (user_id) LEFT JOIN fi USING (item_id)"""


def _asked_pairs(m):
    """Every training pair and every item for an unknown user."""
    unknown = m.items().select(F.lit(UNKNOWN_USER).cast("bigint").alias("user_id"), "item_id", F.lit(None).cast("double").alias("rating"))
    return _train(m).select("user_id", "item_id", F.col("rating").cast("double").alias("rating")).unionByName(unknown)


@register("predict_pairs", _PAIRS_SQL)
def predict_pairs(m):
    """R7 on the stated factor table: users and items outside it fall back to the parts that exist."""
    return R.predict_pairs(_fixed_model(m), _asked_pairs(m)).select("user_id", "item_id", "rating", "est")


@register("predict_pairs_mf")
def predict_pairs_mf(m):
    """R7 with the fitted factorisation."""
    return R.predict_pairs(_fit(m), _asked_pairs(m))


@register("rmse_mae", """
, p AS (SELECT r.rating, i.m AS est FROM ratings r JOIN (SELECT item_id, avg(rating) AS m FROM ratings GROUP BY item_id) i
        ON r.item_id = i.item_id)
SELECT round(sqrt(avg((rating - est) * (rating - est))), 6) AS rmse, round(avg(abs(rating - est)), 6) AS mae, count(*) AS n FROM p""")
def rmse_mae(m):
    """R5 on a fixed predictor (each item's mean rating), so the value is exact."""
    r = m.ratings()
    means = r.groupBy("item_id").agg(F.avg(F.col("rating").cast("double")).alias("est"))
    out = R.rmse_mae(r.join(means, "item_id"))
    return out.select(F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), "n")


_CV_SQL = _FOLD_SQL + f"""
, bi AS (SELECT g.fold, t.item_id, (coalesce(sum(t.r) FILTER (WHERE t.fold <> g.fold), 0) - count(*) FILTER (WHERE t.fold <> g.fold) * any_value(g.mu)) / (count(*) FILTER (WHERE t.fold <> g.fold) + 10.0) AS b
         FROM t, fm g GROUP BY 1, 2),
  bu AS (SELECT g.fold, t.user_id, sum(t.r - g.mu - bi.b) / (count(*) + 15.0) AS b FROM t JOIN fm g ON t.fold <> g.fold JOIN bi ON bi.fold = g.fold AND bi.item_id = t.item_id GROUP BY 1, 2),
  bias_est AS (SELECT t.*, greatest(0.5, least(5.0, fm.mu + bi.b + coalesce(bu.b, 0.0))) AS est FROM t JOIN fm USING (fold) JOIN bi USING (fold, item_id) LEFT JOIN bu USING (fold, user_id)),
  normal_est AS (SELECT t.*, greatest(0.5, least(5.0, sqrt(-2 * ln(({_hash_sql('user_id, item_id', SEED)} + 1) / 1152921504606846976.0::DOUBLE))
    * cos(2 * pi() * ({_hash_sql('user_id, item_id', SEED + 1)} / 1152921504606846976.0::DOUBLE)) * sqrt(greatest(0.0, fm.m2 - fm.mu * fm.mu)) + fm.mu)) AS est FROM t JOIN fm USING (fold)),
  e AS (SELECT 'bias' AS model, fold, r - est AS d FROM bias_est UNION ALL SELECT 'knn', fold, r - est FROM knn_est UNION ALL SELECT 'normal', fold, r - est FROM normal_est),
  cv AS (SELECT model, fold, sqrt(avg(d * d)) AS rmse, avg(abs(d)) AS mae, count(*) AS n FROM e GROUP BY 1, 2),
  means AS (SELECT model, avg(rmse) AS mean_rmse, avg(mae) AS mean_mae FROM cv GROUP BY 1),
  winner AS (SELECT model AS best_model, mean_rmse AS best_rmse FROM means ORDER BY mean_rmse, CASE model WHEN 'knn' THEN 1 WHEN 'bias' THEN 2 ELSE 3 END LIMIT 1)
"""


@register("cross_validate", _CV_SQL + "SELECT model, fold, round(rmse, 6) AS rmse, round(mae, 6) AS mae, n FROM cv")
def cross_validate(m):
    """3-fold RMSE/MAE of the bias-only, kNN and normal predictors on the same data."""
    return _folds(m).withColumns({c: F.round(c, 6) for c in ("rmse", "mae")})


@register("cross_validate_mf")
def cross_validate_mf(m):
    """R4 of the factorisation (one fit per fold) on the same folds."""
    return E.cross_validate(_train(m), ("mf",), CONFIG.cv_folds, SEED, mf_params=CONFIG.mf_params())


def _all_folds(m):
    """The fold metrics of every candidate: the factorisation and the models that SQL can repeat."""
    return _folds(m).unionByName(cross_validate_mf(m))


@register("cv_mean", _CV_SQL + "SELECT model, round(mean_rmse, 6) AS mean_rmse, round(mean_mae, 6) AS mean_mae FROM means")
def cv_mean(m):
    return E.cv_mean(_folds(m)).withColumns({c: F.round(c, 6) for c in ("mean_rmse", "mean_mae")})


@register("best_of")
def best_of(m):
    """A26 over all candidates, the factorisation included."""
    return E.best_of(E.cv_mean(_all_folds(m))).withColumn("best_rmse", F.round("best_rmse", 6))


@register("recommend_users", _LISTS_SQL + "SELECT * FROM lists")
def recommend_users(m):
    """Top-5 unseen items for every user (plus an unknown id: no rows)."""
    return _lists(m)


def fit_and_recommend(m):
    """R8 with the fit of its model: top-5 lists of the factorisation for every user."""
    return R.recommend_users(_fit(m), _requested_users(m), m.ratings(), m.items(), TOP_N)


@register("recommend_batch")
def recommend_batch(m):
    """The factorisation is fitted and the lists of all users come in one job."""
    return fit_and_recommend(m)


@register("recommend_routed", _COLD_SQL + _LISTS_SQL + f"""
, open_users AS (SELECT user_id, user_id NOT IN (SELECT user_id FROM ratings) AS is_new FROM req WHERE user_id NOT IN (SELECT user_id FROM lists)),
  cs AS (SELECT user_id, rank, item_id, movie, score FROM genre_rows UNION ALL SELECT user_id, rank, item_id, movie, score FROM pop_rows)
SELECT *, 'collaborative_filtering' AS method FROM lists WHERE user_id IN (SELECT user_id FROM ratings)
UNION ALL SELECT cs.*, CASE WHEN is_new THEN 'cold_start' ELSE 'cold_start_fallback' END FROM cs JOIN open_users USING (user_id)
UNION ALL SELECT cs.*, 'cold_start' FROM cs WHERE user_id NOT IN (SELECT user_id FROM ratings) AND user_id IN (SELECT user_id FROM lists)""")
def recommend_routed(m):
    """Cold start for new users, model lists for known users, fallback when empty."""
    return R.recommend_routed(_fixed_model(m), _requested_users(m), m.ratings(), m.items(), m.item_genres(),
                              m.genres(), TOP_N)


@register("user_top_score_lists", _LISTS_SQL + f"""
SELECT u.user_id, max(l.score) AS top_score FROM (SELECT user_id FROM users UNION ALL SELECT {UNKNOWN_USER}) u LEFT JOIN lists l ON u.user_id = l.user_id GROUP BY u.user_id""")
def user_top_score_lists(m):
    """A16 on model lists: best score per requested user, NULL without a list."""
    return A.user_top_score(_lists(m), _requested_users(m))


_RUNS_SQL = """
, y AS (SELECT *, CAST(year(to_timestamp("timestamp")) AS INTEGER) AS period FROM ratings),
  cells AS (SELECT item_id, period, sum(rating) AS s, sum(rating * rating) AS ss, count(*) AS n, max("timestamp") AS last_at FROM y GROUP BY 1, 2),
  pm AS (SELECT period, start, sum(ps) OVER w / sum(pn) OVER w AS mu FROM (SELECT period, sum(s) AS ps, sum(n) AS pn, max(last_at) AS start FROM cells GROUP BY 1) x
         WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  past AS (SELECT *, coalesce(sum(s) OVER w, 0) AS s0, coalesce(sum(n) OVER w, 0) AS n0 FROM cells
           WINDOW w AS (PARTITION BY item_id ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  known AS (SELECT past.*, start, mu, greatest(0.5, least(5.0, mu + (s0 - n0 * mu) / (n0 + 10.0))) AS est FROM past JOIN pm USING (period) WHERE mu IS NOT NULL),
  judged AS (SELECT period, start, sqrt(sum(ss - 2 * est * s + est * est * n) / sum(n)) AS bias, sqrt(sum(ss - 2 * mu * s + mu * mu * n) / sum(n)) AS dummy FROM known GROUP BY 1, 2),
  trained AS (SELECT *, least(bias, dummy) AS best, min(least(bias, dummy)) OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM judged),
  active AS (SELECT period, user_id FROM (SELECT period, user_id, row_number() OVER (PARTITION BY period ORDER BY count(*) DESC, user_id) AS rn FROM y GROUP BY 1, 2) x WHERE rn = 1),
  predicted AS (SELECT a.period, a.user_id, k.start, max(k.est) AS top FROM active a JOIN y USING (period, user_id) JOIN known k USING (period, item_id) GROUP BY 1, 2, 3),
  runs AS (SELECT 'train_' || period AS run_name, 'train' AS kind, start, CASE WHEN prior IS NULL OR best < prior THEN 'true' ELSE 'false' END AS is_best_model,
             CASE WHEN bias <= dummy THEN 'bias' ELSE 'normal' END AS best_algorithm, bias, dummy, best, NULL::DOUBLE AS top FROM trained
           UNION ALL SELECT 'Prediction_User_' || user_id || '_' || period, 'predict', start + 1, NULL, NULL, NULL, NULL, NULL, top FROM predicted)
"""


@register("log_run", _RUNS_SQL + "SELECT run_name, kind, start AS start_time, is_best_model, best_algorithm, round(best, 6) AS best_rmse, round(top, 6) AS top_score FROM runs")
def log_run(m):
    """The run history of the ratings: a training and a prediction run per year, each training run judged as of its time."""
    return RU.read_runs(m.spark, _history(m)).select(
        "run_name", "kind", F.unix_timestamp("start_time").alias("start_time"), F.col("params")["is_best_model"].alias("is_best_model"),
        F.col("params")["best_algorithm"].alias("best_algorithm"), F.round(F.col("metrics")["best_rmse"], 6).alias("best_rmse"), F.round(F.col("metrics")["top_score"], 6).alias("top_score"))


@register("latest_run", _RUNS_SQL + "SELECT run_name, kind, start AS start_time FROM runs ORDER BY start DESC LIMIT 1")
def latest_run(m):
    return RU.latest_run(RU.read_runs(m.spark, _history(m))).select("run_name", "kind", F.unix_timestamp("start_time").alias("start_time"))


@register("best_run", _RUNS_SQL + "SELECT run_name, round(best, 6) AS best_rmse FROM runs WHERE best IS NOT NULL ORDER BY best, start DESC LIMIT 1")
def best_run(m):
    return RU.best_run(RU.read_runs(m.spark, _history(m))).select("run_name", F.round("best_rmse", 6).alias("best_rmse"))


@register("run_status_metrics", _RUNS_SQL + """
, last AS (SELECT * FROM runs WHERE kind = 'train' ORDER BY start DESC LIMIT 1)
SELECT metric, round(value, 6) AS value FROM (SELECT unnest(['bias_rmse', 'dummy_rmse', 'best_rmse']) AS metric, unnest([bias, dummy, best]) AS value FROM last) x""")
def run_status_metrics(m):
    """The metrics of the latest training run, one row each."""
    out = RU.run_status_metrics(RU.read_runs(m.spark, _history(m)))
    return out.select(F.explode("metrics").alias("metric", "value")).withColumn("value", F.round("value", 6))


def _promote(m, metrics):
    """The best model of the metrics against the best earlier run of the history; fitted on all training rows, saved and
    logged when it is better, absent or forced."""
    spark, path = m.spark, scratch_path(m.spark, "model")
    runs_path = _history(m)
    best = E.best_of(E.cv_mean(metrics)).first()
    prev = RU.best_run(RU.read_runs(spark, runs_path)).first()
    do_train, is_best = E.should_train_final(prev.best_rmse if prev else None, False, False, best.best_rmse)
    if do_train:
        E.save_winner(best.best_model, _train(m), path, SEED, CONFIG.mf_params())
    RU.log_run(spark, runs_path, "train", "promotion", {"best_algorithm": best.best_model, "is_best_model": str(is_best).lower(), "trained": E.load_winner(spark, path)[0]},
               {"best_rmse": best.best_rmse, "previous_best_rmse": prev.best_rmse})
    p, v = F.col("params"), F.col("metrics")
    return RU.read_runs(spark, runs_path).filter("run_name = 'promotion'").select(
        p["best_algorithm"].alias("best_algorithm"), p["is_best_model"].alias("is_best_model"), p["trained"].alias("trained"),
        F.round(v["best_rmse"], 6).alias("best_rmse"), F.round(v["previous_best_rmse"], 6).alias("previous_best_rmse"))


@register("select_and_promote", _CV_SQL + _RUNS_SQL + """
, prev AS (SELECT min(best) AS p FROM runs)
SELECT best_model AS best_algorithm, CASE WHEN best_rmse < p THEN 'true' ELSE 'false' END AS is_best_model, best_model AS trained, round(best_rmse, 6) AS best_rmse,
       round(p, 6) AS previous_best_rmse FROM winner, prev""")
def select_and_promote(m):
    """R6 over the bias-only, kNN and normal models, with the run history of the ratings before it."""
    return _promote(m, _folds(m))


@register("select_and_promote_mf")
def select_and_promote_mf(m):
    """R6 with the factorisation among the candidates."""
    return _promote(m, _all_folds(m))


@register("save_model", _TRAIN_SQL + """
, g AS (SELECT sum(rating) / count(*) AS mu FROM train)
SELECT item_id, round((sum(rating) - count(*) * any_value(mu)) / (count(*) + 10.0), 6) AS b_i FROM train, g GROUP BY item_id""")
def save_model(m):
    """The stored item biases (the part of the model that SQL can repeat)."""
    path = scratch_path(m.spark, "model")
    R.save_model(_fit(m), path)
    return m.spark.read.parquet(f"{path}/item_bias").select("item_id", F.round("b_i", 6).alias("b_i"))


@register("load_model", _PAIRS_SQL)
def load_model(m):
    """The stated factor table saved, loaded and used for R7."""
    path = scratch_path(m.spark, "model")
    R.save_model(_fixed_model(m), path)
    return R.predict_pairs(R.load_model(m.spark, path), _asked_pairs(m)).select("user_id", "item_id", "rating", "est")


@register("write_topn_csv", _LISTS_SQL + "SELECT user_id, rank, movie, score FROM lists")
def write_topn_csv(m):
    """The lists as one CSV dataset (user_id, rank, movie, score), read back."""
    path = scratch_path(m.spark, "topn-csv-out")
    W.write_topn_csv(_lists(m), path)
    return W.read_topn_csv(m.spark, path)
