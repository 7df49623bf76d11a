"""Sampling, folds and synthetic rating generation.

Random choices are hash-based: the order key is a 60-bit md5 prefix of the
keys and the seed, so a sample is the same for any partitioning, survives task
retries (an executor lost mid-job recomputes exactly the same rows) and can be
repeated by any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.functions.columns import hash_order, random_rating
from reelrank.operators.topk import top_k

HASH_SPAN = 1 << 60


def sample_n(df: DataFrame, n: int, keys: list[str], seed: int = 0) -> DataFrame:
    """M1/M2/M5: exactly min(n, rows) rows without replacement, reproducible.

    The rows are the n smallest by hash. Rows whose hash falls in the lowest
    ~(n/rows * 1.05 + margin) share of the hash space are kept first (a
    map-side filter), and the exact n are taken from them; if they fall short
    the range is widened. So the final ordered take merges about n rows, not n
    per partition.
    """
    total = df.count()
    if n >= total:
        return df
    ordered = df.withColumn("_h", hash_order(keys, seed))
    frac = min(1.0, n / total * 1.05 + 1000.0 / total)
    while True:
        kept = ordered.filter(F.col("_h") < F.lit(int(frac * HASH_SPAN)))
        if frac >= 1.0 or kept.count() >= n:
            break
        frac = min(1.0, frac * 1.5)
    return kept.orderBy("_h", *keys).limit(n).drop("_h")


def kfold(df: DataFrame, keys: list[str], k: int = 3, seed: int = 0) -> DataFrame:
    """M4: fold column 0..k-1 from the hash of the keys."""
    return df.withColumn("fold", F.pmod(hash_order(keys, seed), F.lit(k)).cast("int"))


def random_rows(ratings: DataFrame, items: DataFrame, n: int = 10, seed: int = 0,
                user_id: int | None = None) -> DataFrame:
    """N pseudo-random ratings with titles, optionally of one user."""
    r = ratings if user_id is None else ratings.filter(F.col("user_id") == user_id)
    picked = sample_n(r, n, ["user_id", "item_id"], seed)
    return (picked.join(items.select("item_id", "title"), "item_id")
            .select("user_id", "item_id", F.col("rating").cast("double").alias("rating"), "timestamp", "title"))


def random_ids(df: DataFrame, key: str, n: int = 500, seed: int = 0) -> DataFrame:
    """M3: n pseudo-random distinct ids."""
    return sample_n(df.select(key).distinct(), n, [key], seed)


def unrated_pairs(pairs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Candidate (user, item) pairs that have no rating (left anti)."""
    return pairs.join(ratings.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def generate_ratings(users: DataFrame, items: DataFrame, ratings: DataFrame, count: int = 10000,
                     seed: int = 0, pool: int = 500, as_of: int | None = None) -> DataFrame:
    """M6 (+ M3, J7, P19, T9): min(count, unrated pairs of the grid) new random ratings.

    The grid is `pool` random users by `pool` random items. Both samples are bounded by the parameter; the item ids
    travel as one array to the sampled users, so the grid is a generator over at most `pool` rows, not a join of
    tables. Rated pairs leave by an anti-join and the `count` smallest by hash stay. Ratings are uniform on 0.5..5.0;
    timestamps are epoch seconds (`as_of`, default now). Returns the rows to append; their real count is the number
    inserted.
    """
    u = random_ids(users, "user_id", pool, seed)
    ids = random_ids(items, "item_id", pool, seed + 1).agg(F.collect_list("item_id").alias("ids")).select("ids").scalar()
    fresh = unrated_pairs(u.select("user_id", F.explode(ids).alias("item_id")), ratings)
    ts = F.lit(as_of) if as_of is not None else F.unix_timestamp()
    picked = fresh.withColumn("_h", hash_order(["user_id", "item_id"], seed)).orderBy("_h", "user_id", "item_id").limit(count).drop("_h")
    return picked.select("user_id", "item_id", random_rating(seed).alias("rating"), ts.cast("bigint").alias("timestamp"))


def limit_rows(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """LIMIT n with a deterministic order (first column integral; exact
    threshold top-k, see operators.topk)."""
    return top_k(df, n, order[0], False, tuple(order[1:]))
