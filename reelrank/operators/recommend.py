"""Rating predictors and top-N lists.

* Biased matrix factorisation (R1): item and user biases by two grouped
  aggregates (b_i = sum(r - mu) / (lambda + n_i), then b_u = sum(r - mu - b_i)
  / (lambda + n_u)), then `pyspark.ml` ALS on the residuals. Same model family
  as the reference's SGD factorisation, different optimiser, so numbers differ.
  ALS takes INT ids: the bias tables carry consecutive numbers (a distributed
  prefix sum) as the id dictionary, so ids of any size work.
* Normal predictor (R3): N(mu, sigma) of the training ratings, clipped.
* Top-N for many users (R8): exact scores mu + b_u + b_i + p_u . q_i of every
  unseen item by bounds. Items lie in blocks of similar bias and factors; no
  item of a block scores above mu + b_u + max b_i + the smaller one of the
  best corner of the block's box and |p_u| max |q_i|. Every user first scores
  the block of the smallest ids (they win ties) and the other one with the
  largest bound; the N-th item found then rules out all blocks whose (clipped)
  bound is below its score, or equals it where all ids are larger, and only
  the others are scored. A group is one item block x one chunk of its users,
  with the users' rated pairs as rows; a `row_number <= N` per user merges the
  blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelrank.config import validate_top_n
from reelrank.functions.columns import RATING_MAX, RATING_MIN, clip_to_scale, hash_order, rating_double
from reelrank.operators.prefix import numbered
from reelrank.session import discard, drop_unreferenced, ship_package, stored

# Block sizing of the top-N product (rows per side of one group).
USERS_PER_CHUNK = 2_000
ITEMS_PER_BLOCK = 4_096
SCORE_BATCH = 64
LEVEL_BITS = 6         # quantile levels per column of the item order
ALS_BLOCKS = 10         # of users, part of the model (starting factors are drawn by block): results must not depend on the cluster's size
ALS_ITEM_BLOCKS = 5     # at most; not part of the model. Every iteration sends the users' factors to nearly all of them
ALS_CHECKPOINT = 2      # iterations whose shuffles stay on disk at once; not part of the model
ALS_STORAGE = "DISK_ONLY"  # its blocks of all ratings and its factors: in memory they take the heap that building and solving blocks needs
REACH_BOUNDS = 1 << 18  # bounds (users x item blocks) computed, and rows sent back, at once


@dataclass
class MFModel:
    mu: float
    user_bias: DataFrame     # user_id, b_u
    item_bias: DataFrame     # item_id, b_i
    user_factors: DataFrame  # user_id, features
    item_factors: DataFrame  # item_id, features
    rank: int
    tables: tuple[DataFrame, ...] = ()  # stored by the fit, may be discarded with the model


@dataclass
class NormalModel:
    mu: float
    sigma: float


def fit_item_biases(ratings: DataFrame, reg_item: float = 10.0):
    """Global mean and regularised item biases (one partial aggregate)."""
    r = ratings.select("item_id", rating_double().alias("r"))
    per_item = r.groupBy("item_id").agg(F.sum("r").alias("s"), F.count(F.lit(1)).alias("n"))
    # the global mean is read from the per-item aggregate; nothing stays cached
    tot = per_item.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mu = float(tot.s) / tot.n if tot.n else 0.0
    return mu, per_item.select("item_id", ((F.col("s") - F.col("n") * mu) / (F.col("n") + reg_item)).alias("b_i"))


def fit_user_biases(left: DataFrame, reg_user: float = 15.0) -> DataFrame:
    """Regularised user biases of what mean and item bias leave of every rating (user_id, left)."""
    per_user = left.groupBy("user_id").agg(F.sum("left").alias("s"), F.count(F.lit(1)).alias("n"))
    return per_user.select("user_id", (F.col("s") / (F.col("n") + reg_user)).alias("b_u"))


def _without_items(ratings: DataFrame, mu: float, item_bias: DataFrame) -> DataFrame:
    """The ratings with `left`, what mean and item bias leave of them, and the columns of item_bias."""
    return ratings.join(item_bias, "item_id").withColumn("left", rating_double() - mu - F.col("b_i"))


def fit_biases(ratings: DataFrame, reg_item: float = 10.0, reg_user: float = 15.0):
    """Global mean and regularised item/user biases (two partial aggregates)."""
    mu, item_bias = fit_item_biases(ratings, reg_item)
    return mu, fit_user_biases(_without_items(ratings.select("user_id", "item_id", "rating"), mu, item_bias), reg_user), item_bias


def fit_mf(ratings: DataFrame, rank: int = 10, max_iter: int = 10, reg: float = 0.1, seed: int = 0,
           reg_item: float = 10.0, reg_user: float = 15.0, blocks: int = ALS_BLOCKS) -> MFModel:
    """Bias-then-ALS. The training set and what the biases leave of it are
    stored once, since ALS runs the plan of its input more than once, and go
    when the next step stands. When the fit returns, only the model is left of
    it on disk and in the executors."""
    spark = ratings.sparkSession
    ratings = stored(ratings.select("user_id", "item_id", "rating"), "train")
    mu, item_bias = fit_item_biases(ratings, reg_item)
    item_bias = stored(numbered(item_bias, ["item_id"], "i"), "item-bias")
    left = stored(_without_items(ratings, mu, item_bias).select("user_id", "i", "left"), "without-items")
    discard(ratings)
    user_bias = stored(numbered(fit_user_biases(left, reg_user), ["user_id"], "u"), "user-bias")
    resid = stored(left.join(user_bias, "user_id").select(
        F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), (F.col("left") - F.col("b_u")).cast("float").alias("residual")), "residuals")
    discard(left)
    users, items = _fit_factors(resid, user_bias, item_bias, rank, max_iter, reg, seed, blocks)
    discard(resid)
    drop_unreferenced(spark)
    return MFModel(mu, user_bias.drop("u"), item_bias.drop("i"), users, items, rank, (user_bias, item_bias, users, items))


def _fit_factors(resid: DataFrame, user_bias: DataFrame, item_bias: DataFrame, rank: int, max_iter: int, reg: float, seed: int, blocks: int):
    """The stored factors (user_id, features), (item_id, features) of ALS on u, i, residual. ALS writes its items' factors into
    the session's checkpoint folder every ALS_CHECKPOINT iterations: long fits survive executor loss, and the shuffles up to
    there are deleted. The items' starting factors are never used (items are solved first), so the items' blocks leave the model
    as it is."""
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, userCol="u", itemCol="i",
              ratingCol="residual", coldStartStrategy="nan", nonnegative=False, seed=seed,
              checkpointInterval=ALS_CHECKPOINT, numUserBlocks=blocks, numItemBlocks=min(blocks, ALS_ITEM_BLOCKS),
              intermediateStorageLevel=ALS_STORAGE, finalStorageLevel=ALS_STORAGE)
    fitted = als.fit(resid)  # ALS keeps its own blocks of the input
    wide = F.col("features").cast("array<double>").alias("features")
    users = fitted.userFactors.join(user_bias, F.col("id") == F.col("u")).select("user_id", wide)
    items = fitted.itemFactors.join(item_bias, F.col("id") == F.col("i")).select("item_id", wide)
    return stored(users, "user-factors"), stored(items, "item-factors")


def fit_normal(ratings: DataFrame) -> NormalModel:
    """Mean and population deviation of the training ratings."""
    row = ratings.select(F.avg(rating_double()), F.stddev_pop(rating_double())).first()
    return NormalModel(float(row[0] or 0.0), float(row[1] or 0.0))


def predict_normal(model: NormalModel, pairs: DataFrame, seed: int = 0) -> DataFrame:
    """R3 predictions: normal draws with the model's mean and deviation, clipped (P20)."""
    return pairs.withColumn("est", normal_draw(F.lit(model.mu), F.lit(model.sigma), seed))


def normal_draw(mu, sigma, seed: int):
    """The clipped draw of a (user, item) pair comes from two keyed hashes by the Box-Muller transform, so it is the same on
    every run and in any SQL engine."""
    u = (hash_order(["user_id", "item_id"], seed) + 1) / float(2**60)
    v = hash_order(["user_id", "item_id"], seed + 1) / float(2**60)
    return clip_to_scale(F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v) * sigma + mu)


def predict_pairs(model: MFModel, pairs: DataFrame) -> DataFrame:
    """Estimate for (user, item); unknown users/items fall back to the
    parts that exist (biases or the mean); clipped to the rating scale. The
    pairs, wide with their factors, are never sorted: per partition of ids the
    model's rows are the hashed side."""
    p, q = (f.select(k, F.col("features").alias(n)) for f, k, n in ((model.user_factors, "user_id", "_p"), (model.item_factors, "item_id", "_q")))
    dot = F.aggregate(F.zip_with("_p", "_q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    known = pairs
    for side, key in ((model.user_bias, "user_id"), (p, "user_id"), (model.item_bias, "item_id"), (q, "item_id")):
        known = known.join(side.hint("shuffle_hash"), key, "left")
    est = F.lit(model.mu) + F.coalesce("b_u", F.lit(0.0)) + F.coalesce("b_i", F.lit(0.0)) + F.coalesce(dot, F.lit(0.0))
    return known.withColumn("est", clip_to_scale(est)).drop("_p", "_q", "b_u", "b_i")


def rmse_mae(predictions: DataFrame, label: str = "rating", est: str = "est") -> DataFrame:
    """RMSE and MAE in one aggregate."""
    err = F.col(label).cast("double") - F.col(est)
    return predictions.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                           F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------------- top-N ----
def _split_order(weights: list[float], bits: int) -> list[tuple[int, int]]:
    """(column, bit of its level) in the order of the splits: each halves the column that is widest so far."""
    width, used, out = list(weights), [0] * len(weights), []
    while len(out) < min(bits, LEVEL_BITS * len(weights)):
        k = max((i for i in range(len(width)) if used[i] < LEVEL_BITS), key=lambda i: width[i])
        out.append((k, LEVEL_BITS - 1 - used[k]))
        used[k] += 1
        width[k] /= 2
    return out


def item_blocks(model: MFModel, user_spread: list[float], size: int) -> DataFrame:
    """(block, ids, q, b, max_b, max_norm, lo, hi, min_id): the model's items in runs of `size`, one row per block with its item
    ids ascending, packed factors and biases, and what bounds its scores: the maxima of bias and norm and the box of its
    factors. Block 0 has the smallest ids, which win ties; the others follow halvings of bias and factors at their quantiles,
    those first that move scores most (user_spread: root mean square of the users' factors)."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
    rows = stored(model.item_factors.join(model.item_bias, "item_id").withColumn("norm", norm), "block-items")
    value = [F.col("b_i"), *[F.col("features")[k] for k in range(model.rank)]]
    cuts = [i / 2**LEVEL_BITS for i in range(1, 2**LEVEL_BITS)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(v).alias(f"s{k}") for k, v in enumerate(value)],
                    *[F.percentile_approx(v, cuts).alias(f"c{k}") for k, v in enumerate(value)]).first()  # one row
    weights = [(seen[f"s{k}"] or 0.0) * w for k, w in enumerate([1.0, *user_spread])]
    bits = max(0, (seen["n"] // size).bit_length() + 3)
    key = F.lit(0).cast("bigint")
    for k, bit in _split_order(weights, min(bits, 60)):
        level = sum((F.when(value[k] > c, 1).otherwise(0) for c in seen[f"c{k}"] or []), F.lit(0))
        rows = rows if f"_l{k}" in rows.columns else rows.withColumn(f"_l{k}", level)
        key = key * 2 + F.shiftright(F.col(f"_l{k}"), bit).bitwiseAND(1)
    last = rows.select("item_id").orderBy("item_id").limit(size).agg(F.max("item_id")).first()[0]
    rows = rows.withColumn("_order", F.when(F.col("item_id") <= F.lit(last), -1).otherwise(key)).select("item_id", "features", "b_i", "norm", "_order")
    at = numbered(rows, ["_order", "item_id"], "at").withColumn("block", F.floor((F.col("at") - 1) / size))
    item = F.sort_array(F.collect_list(F.struct("item_id", "features", "b_i")))
    box = [f(F.col("features")[k]).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in range(model.rank)]
    packed = at.groupBy("block").agg(item.alias("e"), F.max("b_i").alias("max_b"), F.max("norm").alias("max_norm"), F.min("item_id").alias("min_id"), *box)
    lo, hi = (F.array(*[F.col(f"{n}{k}") for k in range(model.rank)]).cast("array<double>").alias(n) for n in ("lo", "hi"))
    return packed.select("block", F.col("e.item_id").alias("ids"), F.flatten("e.features").alias("q"), F.col("e.b_i").alias("b"), "max_b", "max_norm", "min_id", lo, hi)


def _block_topn(n: int, mu: float, rank: int):
    """Top n of one item block for the users of one chunk: cogroup of user and rated rows with the block's row."""

    def top(ids, q, bi, user, p, bu, nth, rated_row, rated_item):
        k = min(n, len(ids))
        for start in range(0, len(user), SCORE_BATCH):
            end = min(start + SCORE_BATCH, len(user))
            s = p[start:end] @ q.T + bi[None, :] + (mu + bu[start:end])[:, None]
            np.clip(s, RATING_MIN, RATING_MAX, out=s)
            i, j = np.searchsorted(rated_row, [start, end])
            s[rated_row[i:j] - start, rated_item[i:j]] = -np.inf
            # every entry at or above the user's known n-th score, else the k-th best of the row, is a candidate (ties
            # included); one sort by (row, -score, item) and the first k per row are kept
            least = nth[start:end].copy()
            new = np.flatnonzero(np.isnan(least))
            if len(new):
                least[new] = np.partition(s[new], len(ids) - k, axis=1)[:, len(ids) - k]
            row, col = np.nonzero(s >= np.maximum(least, RATING_MIN)[:, None])  # rated ones are below the scale
            value = s[row, col]
            order = np.lexsort((col, -value, row))
            row, col, value = row[order], col[order], value[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            yield user[start + row[keep]], ids[col[keep]], value[keep]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        wanted = left.filter(pa.compute.equal(left["kind"], 0)) if left.num_rows else left
        if wanted.num_rows and right.num_rows:
            ids = right["ids"].combine_chunks().flatten().to_numpy()
            q = right["q"].combine_chunks().flatten().to_numpy().reshape(len(ids), rank)
            bi = right["b"].combine_chunks().flatten().to_numpy()
            user = wanted["user_id"].to_numpy()
            order = np.argsort(user)
            user, bu, nth = user[order], wanted["b_u"].to_numpy()[order], wanted["nth"].to_numpy()[order].astype(float)
            p = wanted["features"].combine_chunks().flatten().to_numpy().reshape(len(user), rank)[order]
            rated = left.filter(pa.compute.equal(left["kind"], 1))
            of, item = rated["user_id"].to_numpy(), rated["item_id"].to_numpy()
            row, col = np.minimum(np.searchsorted(user, of), len(user) - 1), np.minimum(np.searchsorted(ids, item), len(ids) - 1)
            hit = (user[row] == of) & (ids[col] == item)
            row, col = row[hit], col[hit]
            by = np.argsort(row, kind="stable")
            found = list(top(ids, q, bi, user, p, bu, nth, row[by], col[by]))
        u, i, v = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"user_id": pa.array(u, pa.int64()), "item_id": pa.array(i, pa.int64()), "score": pa.array(v, pa.float64())})

    return run


def score_blocks(users: DataFrame, rated: DataFrame, blocks: DataFrame, n: int, mu: float, rank: int) -> DataFrame:
    """(user_id, item_id, score): for every row of users (user_id, features, b_u, block, nth) the n best unrated items of that
    block, of those that score at least nth where it is known. rated: user_id, item_id, block. A block's users are dealt into
    chunks of about USERS_PER_CHUNK."""
    ship_package(users.sparkSession)
    parts = F.broadcast(users.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / USERS_PER_CHUNK).alias("_parts")))  # one row per block
    chunk = F.pmod(F.xxhash64("user_id"), F.col("_parts")).alias("chunk")
    wanted = users.join(parts, "block").select("block", chunk, "user_id", "features", "b_u", "nth", F.lit(None).cast("bigint").alias("item_id"), F.lit(0).alias("kind"))
    seen = rated.join(users.select("block", "user_id"), ["block", "user_id"], "left_semi").join(parts, "block").select(
        "block", chunk, "user_id", F.lit(None).cast("array<double>").alias("features"), F.lit(None).cast("double").alias("b_u"),
        F.lit(None).cast("double").alias("nth"), "item_id", F.lit(1).alias("kind"))
    sides = blocks.select("block", "ids", "q", "b").join(parts, "block").select("block", "ids", "q", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)).alias("chunk"))
    return (wanted.unionByName(seen).groupBy("block", "chunk").cogroup(sides.groupBy("block", "chunk"))
            .applyInArrow(_block_topn(n, mu, rank), "user_id bigint, item_id bigint, score double"))


def rated_in(users: DataFrame, ratings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(user_id, item_id, block) of the ratings in the blocks that any of the users (user_id, block) asks for. Most users ask
    for the same few blocks: their items are stored, so that their size is known before the ratings are read."""
    asked = F.broadcast(users.select("block").distinct())  # one row per block
    where = blocks.select("block", "ids").join(asked, "block", "left_semi").select("block", F.explode("ids").alias("item_id"))
    return ratings.select("user_id", "item_id").join(stored(where, "asked-items"), "item_id")


def _best(rows: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _reach(table: list, mu: float, rank: int):
    """Rows (user_id, features, b_u, norm, nth, nth_id) to (user_id, features, b_u, nth, block). Without an n-th score: block 0
    and the one of the others with the largest bound. With one: all others that may hold a better item, or an equal one of a
    smaller id. A bound is the smaller one of box and norms, clipped like a score."""
    block, max_b, max_norm, min_id, lo, hi = (np.array([t[i] for t in table]) for i in range(6))
    step = max(1, min(SCORE_BATCH * 16, REACH_BOUNDS // len(table)))

    def bounds(p, bu, norm):
        box = np.maximum(p, 0) @ hi.T + np.minimum(p, 0) @ lo.T
        return np.clip(mu + bu[:, None] + max_b + np.minimum(box, norm[:, None] * max_norm) + 1e-9, RATING_MIN, RATING_MAX)

    def run(batches):
        for b in batches:
            p = b.column(1).flatten().to_numpy().reshape(b.num_rows, rank)
            bu, norm = b.column(2).to_numpy(), b.column(3).to_numpy()
            nth, nth_id = b.column(4).to_numpy(zero_copy_only=False).astype(float), b.column(5).to_numpy(zero_copy_only=False).astype(float)
            for at in range(0, b.num_rows, step):
                to = slice(at, min(b.num_rows, at + step))
                bound = bounds(p[to], bu[to], norm[to])
                first = np.zeros(bound.shape, bool)
                first[:, block == 0] = True
                if len(block) > 1:
                    first[np.arange(len(bound)), np.argmax(np.where(block == 0, -1.0, bound), axis=1)] = True
                new, score = np.isnan(nth_id[to])[:, None], nth[to][:, None]
                more = ~first & ~((bound < score) | ((bound == score) & (min_id > nth_id[to][:, None])))  # NaN: fewer than n so far
                row, col = np.nonzero(np.where(new, first, more))
                out = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(out) for c in (0, 1, 2, 4)), pa.array(block[col], pa.int64())],
                                                 ["user_id", "features", "b_u", "nth", "block"])

    return run


def reach(users: DataFrame, blocks: DataFrame, mu: float, rank: int) -> DataFrame:
    """(user_id, features, b_u, nth, block) of users (user_id, features, b_u, norm, nth, nth_id), see `_reach`. nth_id is null
    before the first scores and -1 for fewer than n of them. The bounds (one row per block of items) go to all tasks."""
    ship_package(users.sparkSession)
    table = [tuple(r) for r in blocks.select("block", "max_b", "max_norm", "min_id", "lo", "hi").orderBy("block").collect()]
    rows = users.select("user_id", "features", "b_u", "norm", F.col("nth").cast("double"), F.col("nth_id").cast("double"))
    empty = "user_id bigint, features array<double>, b_u double, nth double, block bigint"
    return rows.mapInArrow(_reach(table, mu, rank), empty) if table else users.sparkSession.createDataFrame([], empty)


def top_items(model: MFModel, requested: DataFrame, ratings: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(user_id, rank, item_id, score) of the n best unseen items of every requested user of the model, and the stored
    (user_id, block) pairs that were scored."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
    wanted = requested.select("user_id").distinct()
    users = stored(wanted.join(model.user_factors, "user_id").join(model.user_bias, "user_id").withColumn("norm", norm), "topn-users")
    size = users.agg(*[F.sqrt(F.avg(F.col("features")[k] * F.col("features")[k])).alias(f"p{k}") for k in range(model.rank)], F.count(F.lit(1))).first()
    blocks = stored(item_blocks(model, [float(size[k] or 0.0) for k in range(model.rank)], ITEMS_PER_BLOCK), "item-blocks")
    start = users.withColumns({"nth": F.lit(None).cast("double"), "nth_id": F.lit(None).cast("bigint")})
    first = stored(reach(start, blocks, model.mu, model.rank), "topn-begin")
    found = stored(_best(score_blocks(first, rated_in(first, ratings, blocks), blocks, n, model.mu, model.rank), n), "topn-first")
    # The n-th item of a user rules out the blocks that cannot reach its score, or reach it with larger ids only.
    full = F.count(F.lit(1)) == n
    nth = found.groupBy("user_id").agg(F.when(full, F.min("score")).alias("nth"), F.when(full, F.max_by("item_id", "rank")).otherwise(-1).alias("nth_id"))
    known = users.join(nth, "user_id", "left").withColumn("nth_id", F.coalesce("nth_id", F.lit(-1).cast("bigint")))
    more = stored(reach(known, blocks, model.mu, model.rank), "topn-more")
    rest = score_blocks(more, rated_in(more, ratings, blocks), blocks, n, model.mu, model.rank)
    pairs = first.select("user_id", "block").unionByName(more.select("user_id", "block"))
    return _best(found.drop("rank").unionByName(rest), n), pairs


def recommend_users(model: MFModel, requested: DataFrame, ratings: DataFrame, items: DataFrame,
                    n: int = 5) -> DataFrame:
    """R8 (+J10, J11, U3, T5): top-N unseen items for every requested user.

    Users unknown to the model get no rows (the reference returns an empty
    list). "Seen" is judged on the full ratings. Items without a title are
    dropped after ranking, so a list may be shorter than N.
    """
    validate_top_n(n)
    top, _ = top_items(model, requested, ratings, n)
    titled = top.join(items.select("item_id", F.col("title").alias("movie")), "item_id")
    return titled.select("user_id", "rank", "item_id", "movie", "score")


def recommend_routed(model: MFModel, requested: DataFrame, ratings: DataFrame, items: DataFrame,
                     item_genres: DataFrame, genres: DataFrame, n: int = 5) -> DataFrame:
    """New users -> cold start; known users -> model lists; known users
    with an empty model list -> cold start fallback. The model lists are stored
    and the cold-start lists built once, for both kinds of users."""
    from reelrank.operators.coldstart import cold_start, is_new_user
    flags = is_new_user(requested, ratings)
    cf = stored(recommend_users(model, flags.filter(~F.col("is_new")).select("user_id"), ratings, items, n), "routed")
    open_ = flags.join(cf.select("user_id").distinct(), "user_id", "left_anti")
    cs = cold_start(open_.select("user_id"), ratings, items, item_genres, genres, n).drop("method").join(open_, "user_id")
    cs = cs.withColumn("method", F.when(F.col("is_new"), "cold_start").otherwise("cold_start_fallback"))
    cols = ["user_id", "rank", "item_id", "movie", "score", "method"]
    return cf.withColumn("method", F.lit("collaborative_filtering")).select(*cols).unionByName(cs.select(*cols))


def save_model(model: MFModel, path: str) -> None:
    """save_model: factors, bias tables and mean, overwrite."""
    for name in ("user_bias", "item_bias", "user_factors", "item_factors"):
        getattr(model, name).write.mode("overwrite").parquet(f"{path}/{name}")
    spark = model.user_bias.sparkSession
    spark.createDataFrame([(float(model.mu), int(model.rank))], "mu double, rank int").write.mode(
        "overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> MFModel:
    """load_model: raises when the model folder is missing."""
    meta = spark.read.schema("mu double, rank int").json(f"{path}/meta").first()
    if meta is None:
        raise FileNotFoundError(path)
    return MFModel(meta.mu, *[spark.read.parquet(f"{path}/{name}") for name in ("user_bias", "item_bias", "user_factors", "item_factors")], meta.rank)
