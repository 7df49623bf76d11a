"""Ratings analytics: activity, popularity, genres, statistics, top-k
(A1-A13, A16, J1-J5, T1-T3, T6-T8).

Aggregations run before joins wherever the join key is the grouping key, so
the big ratings table is reduced map-side (partial aggregate) before any
shuffle; the catalogue-sized sides are left to AQE, which broadcasts them
only when their runtime size is under the broadcast threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelrank.functions.columns import (DAMPING, bucket_rank, count_bucket, damped_score,
                                        epoch_to_date, rating_double)
from reelrank.operators.joins import spread_join
from reelrank.operators.topk import top_k


# -- activity / popularity ----------------------------------------------------
def user_activity(ratings: DataFrame, min_count: int = 1) -> DataFrame:
    """A1: users with at least `min_count` ratings."""
    return (ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("num_ratings"))
            .filter(F.col("num_ratings") >= min_count))


def item_popularity(ratings: DataFrame, min_count: int = 1) -> DataFrame:
    """A2: items with at least `min_count` ratings."""
    return (ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("num_ratings"))
            .filter(F.col("num_ratings") >= min_count))


def filter_active_popular(ratings: DataFrame, min_user: int = 50, min_item: int = 100) -> DataFrame:
    """Ratings of active users on popular items.

    Both thresholds are computed on the unfiltered ratings (one pass, not an
    iterated k-core). Two partial aggregates produce the key sets; the
    ratings are then semi-joined to each (AQE broadcasts a key set when it is
    small at run time, otherwise ratings are shuffled once per key).
    """
    active = user_activity(ratings, min_user).select("user_id")
    popular = item_popularity(ratings, min_item).select("item_id")
    return (ratings.join(active, "user_id", "left_semi")
            .join(popular, "item_id", "left_semi")
            .select("user_id", "item_id", "rating"))


def item_stats(ratings: DataFrame) -> DataFrame:
    """Per-item count, average and damped popularity score (partial + final aggregate)."""
    r = rating_double()
    return (ratings.groupBy("item_id")
            .agg(F.count(r).alias("num_ratings"), F.sum(r).alias("_sum"))
            .select("item_id", "num_ratings",
                    (F.col("_sum") / F.col("num_ratings")).alias("avg_rating"),
                    damped_score("_sum", "num_ratings", DAMPING).alias("popularity_score")))


def popularity_stats(ratings: DataFrame, items: DataFrame, min_count: int = 10) -> DataFrame:
    """A3 + J2: items with n >= min_count with title, n, avg and damped score.

    The reference's LEFT JOIN + HAVING n >= 10 is an inner join; the
    aggregate runs on ratings alone, then meets the catalogue.
    """
    stats = item_stats(ratings).filter(F.col("num_ratings") >= min_count)
    return (stats.join(items.select("item_id", "title"), "item_id")
            .select("item_id", "title", "num_ratings", "avg_rating", "popularity_score"))


def _popular_order(prefix: list | None = None):
    return (prefix or []) + [F.col("popularity_score").desc(), F.col("num_ratings").desc(), F.col("item_id").asc()]


def top_popular(ratings: DataFrame, items: DataFrame, n: int = 10, min_count: int = 10) -> DataFrame:
    """ORDER BY score DESC, n DESC (item id breaks ties) LIMIT n.

    Planned as TakeOrderedAndProject: each partition keeps its own top n.
    """
    return popularity_stats(ratings, items, min_count).orderBy(*_popular_order()).limit(n)


def with_genre_names(item_genres: DataFrame, genres: DataFrame) -> DataFrame:
    """item_genres with the genre's `name`. A genre of very many items is spread over several tasks; the runtime broadcasts
    the vocabulary when its bytes allow it."""
    return spread_join(item_genres, genres.select("genre_id", "name"), "genre_id")


def popularity_by_genre(ratings: DataFrame, items: DataFrame, item_genres: DataFrame, genres: DataFrame,
                        genre: str | None = None, min_count: int = 10) -> DataFrame:
    """A4 + J3: popularity per (genre, item). `genre=None` keeps all genres.

    Item statistics are computed once on ratings and then fanned out to the
    item's genres, instead of joining ratings to genres first (which would
    multiply the big side by the genres per item).
    """
    ig = with_genre_names(item_genres, genres)
    if genre is not None:
        ig = ig.filter(F.col("name") == genre)
    pop = popularity_stats(ratings, items, min_count)
    return (pop.join(ig.select("item_id", F.col("name").alias("genre")), "item_id")
            .select("genre", "item_id", "title", "num_ratings", "avg_rating", "popularity_score"))


def top_genre_popular(ratings: DataFrame, items: DataFrame, item_genres: DataFrame, genres: DataFrame,
                      n: int = 10, genre: str | None = None, min_count: int = 10) -> DataFrame:
    """Top n popular items of one genre, or of every genre at once.

    For all genres a `row_number <= n` per genre is planned with a partial
    WindowGroupLimit before the shuffle, so a hot genre only forwards n rows
    per input partition.
    """
    by_genre = popularity_by_genre(ratings, items, item_genres, genres, genre, min_count)
    w = Window.partitionBy("genre").orderBy(*_popular_order())
    return by_genre.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def preferred_genres(ratings: DataFrame, item_genres: DataFrame, genres: DataFrame) -> DataFrame:
    """A5 + J4: per user and genre, average rating and count.

    A rating carries the genres of its item as one array to its user's
    partition and is multiplied by them only there, so the shuffle moves
    ratings and a task holds the genres of its own users.
    """
    ig = with_genre_names(item_genres, genres).groupBy("item_id").agg(F.collect_list(F.struct(F.col("name").alias("genre"))).alias("_genres"))
    r = rating_double()
    return (ratings.select("user_id", "item_id", r.alias("rating")).join(ig, "item_id")
            .select("user_id", "rating", "_genres").repartition("user_id")
            .select("user_id", "rating", F.inline("_genres"))
            .groupBy("user_id", "genre")
            .agg(F.avg("rating").alias("avg_rating"), F.count("rating").alias("num_ratings")))


def top_user_genres(ratings: DataFrame, item_genres: DataFrame, genres: DataFrame, k: int = 3) -> DataFrame:
    """Each user's k preferred genres (avg DESC, n DESC, name ASC)."""
    pg = preferred_genres(ratings, item_genres, genres)
    w = Window.partitionBy("user_id").orderBy(F.col("avg_rating").desc(), F.col("num_ratings").desc(),
                                              F.col("genre").asc())
    return pg.withColumn("genre_rank", F.row_number().over(w)).filter(F.col("genre_rank") <= k)


# -- statistics -------------------------------------------------------------
def recent_days_filter(ratings: DataFrame, days: int | None, as_of: int | None = None) -> DataFrame:
    """P10: timestamp >= as_of - days * 86400; None or 0 keeps everything.

    `as_of` is epoch seconds; by default the current time.
    """
    if not days:
        return ratings
    now = F.lit(as_of) if as_of is not None else F.unix_timestamp()
    return ratings.filter(F.col("timestamp") >= now - F.lit(days * 86400))


def data_statistics(ratings: DataFrame, days_back: int | None = None, as_of: int | None = None,
                    approx: bool = False) -> DataFrame:
    """One-row statistics record; NULL aggregates become 0.

    Exact distinct counts are planned by Catalyst as one Expand + two-level
    aggregate over a single scan; `approx=True` uses HyperLogLog sketches
    (no shuffle of keys at all).
    """
    r = recent_days_filter(ratings, days_back, as_of)
    rating = rating_double()
    day = epoch_to_date("timestamp")
    cd = F.approx_count_distinct if approx else F.count_distinct
    agg = r.agg(
        cd("user_id").alias("num_users"), cd("item_id").alias("num_movies"),
        F.count(F.lit(1)).alias("num_ratings"), F.avg(rating).alias("avg_rating"),
        F.stddev_samp(rating).alias("std_rating"), F.min(rating).alias("min_rating"),
        F.max(rating).alias("max_rating"), cd(day).alias("num_days"))
    return agg.select(
        F.col("num_users").cast("bigint").alias("num_users"),
        F.col("num_movies").cast("bigint").alias("num_movies"),
        F.col("num_ratings").cast("bigint").alias("num_ratings"),
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        F.coalesce(F.round("std_rating", 6), F.lit(0.0)).alias("std_rating"),
        F.coalesce("min_rating", F.lit(0.0)).alias("min_rating"),
        F.coalesce("max_rating", F.lit(0.0)).alias("max_rating"),
        F.col("num_days").cast("bigint").alias("num_days"))


def recent_statistics(ratings: DataFrame, days: int = 7, as_of: int | None = None) -> DataFrame:
    """Statistics of the last `days` days plus `period_days`."""
    return data_statistics(ratings, days, as_of).withColumn("period_days", F.lit(days))


def _count_histogram(ratings: DataFrame, key: str, label: str) -> DataFrame:
    counts = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("rating_count"))
    return (counts.groupBy(count_bucket("rating_count").alias("category"),
                           bucket_rank("rating_count").alias("bucket_rank"))
            .agg(F.count(F.lit(1)).alias(label))
            .orderBy("bucket_rank"))


def user_count_histogram(ratings: DataFrame) -> DataFrame:
    """A8 + P13/P14: number of users per activity bucket, in bucket order."""
    return _count_histogram(ratings, "user_id", "num_users")


def item_count_histogram(ratings: DataFrame) -> DataFrame:
    """Number of items per popularity bucket."""
    return _count_histogram(ratings, "item_id", "num_movies")


def filter_impact(ratings: DataFrame, min_user: int = 50, min_item: int = 100) -> DataFrame:
    """A10 + P25: rows kept by J1 and the sizes of the two key sets."""
    active = user_activity(ratings, min_user)
    popular = item_popularity(ratings, min_item)
    kept = filter_active_popular(ratings, min_user, min_item)
    total = ratings.select(F.count(F.lit(1))).scalar()
    n_users = active.select(F.count(F.lit(1))).scalar()
    n_items = popular.select(F.count(F.lit(1))).scalar()
    return kept.agg(F.count(F.lit(1)).alias("filtered_ratings")).select(
        F.lit(min_user).alias("min_user"), F.lit(min_item).alias("min_item"),
        total.alias("total_ratings"), "filtered_ratings",
        F.round(F.col("filtered_ratings") / total * 100, 2).alias("pct_kept"),
        n_users.alias("filtered_users"), n_items.alias("filtered_movies"))


def filter_sweep(ratings: DataFrame, thresholds=((10, 20), (20, 50), (30, 75))) -> DataFrame:
    """Rows kept for several (min_user, min_item) pairs in one pass.

    Per-row user and item counts are attached once (two aggregates joined
    back on their keys), then one conditional aggregate counts every pair.
    """
    uc = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_user"))
    ic = ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    rows = ratings.select("user_id", "item_id").join(uc, "user_id").join(ic, "item_id")
    aggs = [F.count(F.lit(1)).alias("total")]
    for i, (mu, mi) in enumerate(thresholds):
        aggs.append(F.count(F.when((F.col("n_user") >= mu) & (F.col("n_item") >= mi), 1)).alias(f"k{i}"))
    wide = rows.agg(*aggs)
    stack = ", ".join(f"{mu}, {mi}, k{i}" for i, (mu, mi) in enumerate(thresholds))
    long = wide.selectExpr("total", f"stack({len(thresholds)}, {stack}) AS (min_user, min_item, filtered_ratings)")
    return long.select(F.col("min_user").cast("int"), F.col("min_item").cast("int"),
                       F.col("filtered_ratings").cast("bigint"),
                       F.round(F.col("filtered_ratings") / F.col("total") * 100, 2).alias("pct_kept"))


def table_totals(users: DataFrame, items: DataFrame, ratings: DataFrame) -> DataFrame:
    """Counts of users, items, ratings and the average rating rounded to 2.

    One aggregate over ratings; the two dimension counts are scalar
    subqueries (no join of one-row frames).
    """
    r = rating_double()
    return ratings.agg(F.count(F.lit(1)).alias("ratings"), F.avg(r).alias("_avg")).select(
        users.select(F.count(F.lit(1))).scalar().alias("users"),
        items.select(F.count(F.lit(1))).scalar().alias("movies"),
        "ratings", F.round("_avg", 2).alias("average_rating"))


def distinct_counts(ratings: DataFrame) -> DataFrame:
    """Total rows, distinct users, distinct items."""
    return ratings.agg(F.count(F.lit(1)).alias("total_ratings"),
                       F.count_distinct("user_id").alias("total_users"),
                       F.count_distinct("item_id").alias("total_movies"))


def user_top_score(lists: DataFrame, users: DataFrame) -> DataFrame:
    """Best score of each requested user's list; NULL when no list."""
    best = lists.groupBy("user_id").agg(F.max("score").alias("top_score"))
    return users.select("user_id").join(best, "user_id", "left")


# -- top-k reports ----------------------------------------------------------
def latest_rows(ratings: DataFrame, n: int = 10000) -> DataFrame:
    """The n most recent ratings (ties by user, item); exact threshold
    top-k, so no single task merges partitions x n rows."""
    return top_k(ratings, n, "timestamp", True, ("user_id", "item_id"))


def oldest_rows(ratings: DataFrame, n: int = 10000) -> DataFrame:
    """The n oldest ratings (ties by user, item)."""
    return top_k(ratings, n, "timestamp", False, ("user_id", "item_id"))


def top_titles_by_count(ratings: DataFrame, items: DataFrame, min_count: int = 100, n: int = 100) -> DataFrame:
    """Most rated items with at least `min_count` ratings (ties by id)."""
    pop = item_popularity(ratings, min_count)
    top = pop.orderBy(F.col("num_ratings").desc(), F.col("item_id").asc()).limit(n)
    return top.join(items.select("item_id", "title"), "item_id").select("item_id", "title", "num_ratings")


def ratings_with_titles(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Ratings joined to titles (inner)."""
    return ratings.join(items.select("item_id", "title"), "item_id")


def filter_by_id(df: DataFrame, column: str, value) -> DataFrame:
    """Equality filter (pushed to the scan)."""
    return df.filter(F.col(column) == F.lit(value))

