"""Cold start for many users at once.

No per-user loop: requested users are split into "has ratings" and "new"
with one join; users with ratings get lists merged from their preferred
genres, new users (or users whose items carry no genre) get the global
popular list. Every per-user group is bounded (at most k genres x quota
rows); the shared lists are bounded by their own limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelrank.operators.analytics import top_genre_popular, top_popular, top_user_genres
from reelrank.operators.joins import spread_join


def is_new_user(requested: DataFrame, ratings: DataFrame) -> DataFrame:
    """Flag per requested user; True when the user has no rating."""
    rated = ratings.select("user_id").distinct().withColumn("_has", F.lit(True))
    return (requested.select("user_id").join(rated, "user_id", "left")
            .select("user_id", F.col("_has").isNull().alias("is_new")))


def is_new_item(requested: DataFrame, ratings: DataFrame) -> DataFrame:
    """Flag per requested item; True when the item has no rating."""
    rated = ratings.select("item_id").distinct().withColumn("_has", F.lit(True))
    return (requested.select("item_id").join(rated, "item_id", "left")
            .select("item_id", F.col("_has").isNull().alias("is_new")))


def genre_quota(n: int, k_col) -> F.Column:
    """T4 quota: max(2, N // k + 1) items per preferred genre."""
    return F.greatest(F.lit(2), F.floor(F.lit(n) / k_col).cast("int") + 1)


def popular_list_rows(requested: DataFrame, ratings: DataFrame, items: DataFrame, n: int,
                      min_count: int = 10) -> DataFrame:
    """The global top-n list attached to each requested user.

    The list (n rows) is folded into one array value by a scalar subquery and
    exploded per user: a generator, not a join, and bounded by n.
    """
    top = top_popular(ratings, items, n, min_count)
    entries = F.collect_list(F.struct("item_id", "title", F.col("popularity_score").alias("score"), "num_ratings"))
    arr = top.select(entries).scalar()
    exploded = requested.select("user_id", F.explode(arr).alias("e"))
    rows = exploded.select("user_id", "e.item_id", F.col("e.title").alias("movie"), F.col("e.score").alias("score"),
                           F.col("e.num_ratings").alias("num_ratings"))
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("num_ratings").desc(),
                                              F.col("item_id").asc())
    return rows.withColumn("rank", F.row_number().over(w)).drop("num_ratings")


def cold_start(requested: DataFrame, ratings: DataFrame, items: DataFrame, item_genres: DataFrame,
               genres: DataFrame, n: int = 5, k: int = 3, min_count: int = 10, dedupe: bool = False) -> DataFrame:
    """Cold-start lists for every requested user.

    Output: user_id, rank, item_id, movie, score, method ('genres' or 'popular').
    Lists merged from several genres keep duplicates unless `dedupe`; the
    merge is a stable sort by score over the genre lists in preference order.
    """
    req = requested.select("user_id").distinct()
    rated = ratings.join(req, "user_id", "left_semi")
    prefs = top_user_genres(rated, item_genres, genres, k)
    kcount = Window.partitionBy("user_id")
    prefs = prefs.withColumn("k", F.count(F.lit(1)).over(kcount)).withColumn("quota", genre_quota(n, F.col("k")))

    max_quota = max(2, n + 1)
    lists = top_genre_popular(ratings, items, item_genres, genres, max_quota, None, min_count)
    lists = lists.select("genre", F.col("rank").alias("genre_pos"), "item_id",
                         F.col("title").alias("movie"), F.col("popularity_score").alias("score"))
    # a genre that most users prefer is spread; the runtime broadcasts the lists when their bytes allow it
    merged = (spread_join(prefs, lists, "genre")
              .filter(F.col("genre_pos") <= F.col("quota")))
    if dedupe:
        first = Window.partitionBy("user_id", "item_id").orderBy(F.col("score").desc(), "genre_rank", "genre_pos")
        merged = merged.withColumn("_f", F.row_number().over(first)).filter(F.col("_f") == 1).drop("_f")
    w = Window.partitionBy("user_id").orderBy(F.col("score").desc(), F.col("genre_rank").asc(),
                                              F.col("genre_pos").asc())
    genre_rows = (merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
                  .select("user_id", "rank", "item_id", "movie", "score", F.lit("genres").alias("method")))

    without = req.join(prefs.select("user_id").distinct(), "user_id", "left_anti")
    pop_rows = (popular_list_rows(without, ratings, items, n, min_count)
                .select("user_id", "rank", "item_id", "movie", "score", F.lit("popular").alias("method")))
    return genre_rows.unionByName(pop_rows)
