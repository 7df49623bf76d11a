"""Registered queries: one Spark plan per operator key, each with its SQL
oracle (DuckDB) when the result is exactly repeatable.

Every query reads the driver tables of `sf_dir` (or data Spark derives from
them) in full; parameters follow the reference defaults except where the
driver data makes a default empty (thresholds 30/25 instead of 50/100,
popular-title count 35 instead of 100), as noted per query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reelrank.functions import columns as C
from reelrank.operators import analytics as A
from reelrank.operators import coldstart as CS
from reelrank.operators import drift as D
from reelrank.operators import ingest as I
from reelrank.operators import quality as Q
from reelrank.operators import sampling as M
from reelrank.plans.oracle_base import with_model
from reelrank.session import ensure_checkpoint_dir, require_utc, scratch_path
from reelrank.sinks import writers as W
from reelrank.sources import schemas as S
from reelrank.sources.driver import DriverModel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Parameters of the registered queries.
MIN_USER, MIN_ITEM = 30, 25          # J1/A10 (50/100 keeps nothing on the driver data)
POPULAR_MIN = 35                     # T7 / novelty threshold (100 keeps nothing)
UNKNOWN_USER = 999999999             # cold-start probe id used by the reference tests
RECENT_DAYS = 365
LOG_DAYS = 7


def _norm(df: DataFrame) -> DataFrame:
    """Decimals leave registered queries as DOUBLE (same as the oracles)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols.append(c.cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else c)
    return df.select(*cols)


def register(key: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            require_utc(spark)
            ensure_checkpoint_dir(spark)
            return _norm(fn(DriverModel(spark, sf_dir)))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_model(sql)
        return fn
    return deco


def _hash_sql(cols: str, seed: int) -> str:
    """hash_order in DuckDB: the first 60 bits of md5("key|...|seed")."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {cols}, '{seed}')), 1, 15) AS BIGINT)"


def _max_ts(m: DriverModel):
    return m.ratings().select(F.max("timestamp")).scalar()


def _roundtrip_csv(m: DriverModel, df: DataFrame, name: str, schema) -> DataFrame:
    path = scratch_path(m.spark, name)
    W.write_csv(df, path)
    return W.read_csv(m.spark, path, schema)


_LOGS: dict[tuple[str, str], str] = {}


def _log(m: DriverModel) -> DataFrame:
    """Derived recommendation log, written as JSON lines once per application and table set, and scanned back."""
    key = (m.spark.sparkContext.applicationId, m.sf_dir)
    if key not in _LOGS:
        path = scratch_path(m.spark, "reco-log")
        Q.append_reco_log(Q.log_entries_from_events(m.events(), m.items()), path)
        _LOGS[key] = path
    return Q.scan_reco_log(m.spark, _LOGS[key])


def _requested_users(m: DriverModel) -> DataFrame:
    extra = m.spark.range(1).select(F.lit(UNKNOWN_USER).cast("bigint").alias("user_id"))
    return m.users().unionByName(extra)


# ---------------------------------------------------------------- scans ----
@register("scan_items_csv", 'SELECT "movieId", title, genres FROM raw_items')
def scan_items_csv(m):
    return _roundtrip_csv(m, m.raw_items(), "items-csv", S.CSV_ITEMS)


@register("scan_ratings_csv", 'SELECT user_id AS "userId", item_id AS "movieId", rating, "timestamp" FROM ratings')
def scan_ratings_csv(m):
    return _roundtrip_csv(m, m.raw_ratings(), "ratings-csv", S.CSV_RATINGS)


@register("scan_tags_csv", 'SELECT "userId", "movieId", tag, "timestamp" FROM raw_tags')
def scan_tags_csv(m):
    return _roundtrip_csv(m, m.raw_tags(), "tags-csv", S.CSV_TAGS)


@register("scan_links_csv", 'SELECT item_id AS "movieId", imdb_id AS "imdbId", tmdb_id AS "tmdbId" FROM links')
def scan_links_csv(m):
    return _roundtrip_csv(m, m.raw_links(), "links-csv", S.CSV_LINKS)


@register("scan_genome_tags_csv", 'SELECT tag_id AS "tagId", tag FROM genome_tags')
def scan_genome_tags_csv(m):
    return _roundtrip_csv(m, m.raw_genome_tags(), "genome-tags-csv", S.CSV_GENOME_TAGS)


@register("scan_genome_scores_csv",
          'SELECT item_id AS "movieId", tag_id AS "tagId", CAST(relevance AS DOUBLE) AS relevance FROM genome_scores')
def scan_genome_scores_csv(m):
    return _roundtrip_csv(m, m.raw_genome_scores(), "genome-scores-csv", S.CSV_GENOME_SCORES)


@register("scan_ratings_table", "SELECT user_id, item_id, rating FROM ratings")
def scan_ratings_table(m):
    return m.ratings().select("user_id", "item_id", "rating")


@register("scan_items_table", "SELECT item_id, title FROM items")
def scan_items_table(m):
    return m.items().select("item_id", "title")


@register("scan_reco_log", """
SELECT "timestamp", user_id, method, num_recommendations, array_to_string(titles, '|') AS titles,
       round(list_sum(scores), 4) AS score_total
FROM reco_log""")
def scan_reco_log(m):
    log = _log(m)
    return log.select("timestamp", "user_id", "method", "num_recommendations",
                      F.array_join(F.transform("recommendations", lambda r: r["movie"]), "|").alias("titles"),
                      F.round(F.aggregate(F.transform("recommendations", lambda r: r["score"]), F.lit(0.0),
                                          lambda a, s: a + s), 4).alias("score_total"))


@register("load_baseline_rows", f"""SELECT user_id, item_id, rating, "timestamp" FROM ratings ORDER BY {_hash_sql("user_id, item_id", 42)}, user_id, item_id LIMIT 10000""")
def load_baseline_rows(m):
    path = scratch_path(m.spark, "baseline-rows")
    W.save_baseline_rows(M.sample_n(m.ratings(), 10000, ["user_id", "item_id"], 42), path)
    return W.load_baseline_rows(m.spark, path)


# ---------------------------------------------------------------- sinks ----
@register("append_table", """
, batch AS (SELECT user_id, item_id, CAST(least(10, ceil(l_quantity / 5)) * 0.5 AS DOUBLE) AS rating, ts AS "timestamp"
            FROM li_o WHERE ts >= (SELECT max("timestamp") FROM ratings) - 730 * 86400),
  target AS (SELECT * FROM ratings WHERE "timestamp" < (SELECT max("timestamp") FROM ratings) - 365 * 86400),
  dedup AS (SELECT user_id, item_id, rating, "timestamp" FROM (
              SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY rating, "timestamp") AS rn
              FROM batch) s WHERE rn = 1)
SELECT d.* FROM dedup d WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.user_id = d.user_id AND t.item_id = d.item_id)
""")
def append_table(m):
    """Line-level ratings of the last two years appended to the ratings older
    than one year: duplicates inside the batch and keys already present go."""
    max_ts = _max_ts(m)
    li = m.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    o = m.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    batch = (li.join(o, li.l_orderkey == o.o_orderkey)
             .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                     (F.least(F.lit(10.0), F.ceil(F.col("l_quantity") / 5)) * 0.5).cast("decimal(2,1)").alias("rating"),
                     C.ntz_to_epoch("o_orderdate").alias("timestamp"))
             .filter(F.col("timestamp") >= max_ts - 730 * 86400))
    target = m.ratings().filter(F.col("timestamp") < max_ts - 365 * 86400)
    return I.append_new_rows(batch, target, ["user_id", "item_id"])


@register("write_predict_metrics", """
, best AS (SELECT user_id, max(s) AS top_score FROM (SELECT user_id, unnest(scores) AS s FROM reco_log) x GROUP BY user_id)
SELECT 'user_' || CAST(u.user_id AS VARCHAR) || '_top_score' AS metric, b.top_score AS value
FROM users u LEFT JOIN best b ON u.user_id = b.user_id""")
def write_predict_metrics(m):
    lists = _log(m).select("user_id", F.explode(F.transform("recommendations", lambda r: r["score"])).alias("score"))
    top = A.user_top_score(lists, m.users())
    path = scratch_path(m.spark, "predict-metrics")
    W.write_predict_metrics(top, path)
    return m.spark.read.schema("metric STRING, value DOUBLE").json(path)


# ---------------------------------------------------- projections/filters ----
@register("rename_columns", 'SELECT "movieId" AS item_id, title, genres FROM raw_items')
def rename_columns(m):
    return I.rename_columns(m.raw_items(), "items")


@register("project_columns", "SELECT item_id, imdb_id FROM links")
def project_columns(m):
    return I.project_columns(m.links(), ["item_id", "imdb_id"])


@register("extract_year", "SELECT item_id, title, release_year FROM items")
def extract_year(m):
    return m.items()


@register("split_genres", """
SELECT "movieId" AS item_id, CAST(len(string_split(genres, '|')) AS INTEGER) AS n_genres,
       string_split(genres, '|')[1] AS first_genre FROM raw_items""")
def split_genres(m):
    parts = C.split_genres("genres")
    return m.raw_items().select(F.col("movieId").alias("item_id"), F.size(parts).alias("n_genres"),
                                parts.getItem(0).alias("first_genre"))


@register("explode_genres", "SELECT item_id, genre FROM item_genre_names")
def explode_genres(m):
    return I.explode_genres(m.raw_items())


@register("drop_null_tags", 'SELECT "userId", "movieId", tag, "timestamp" FROM raw_tags WHERE tag IS NOT NULL')
def drop_null_tags(m):
    return I.drop_null_tags(m.raw_tags())


@register("filter_known_tags",
          'SELECT "userId", "movieId", tag, "timestamp" FROM raw_tags WHERE tag IN (SELECT tag FROM tags)')
def filter_known_tags(m):
    return I.filter_known_tags(m.raw_tags(), m.tags())


@register("filter_by_id", "SELECT user_id, item_id, rating, \"timestamp\" FROM ratings WHERE user_id = 1")
def filter_by_id(m):
    return A.filter_by_id(m.ratings(), "user_id", 1)


@register("filter_by_genre", """
SELECT ig.item_id, g.name AS genre FROM item_genres ig JOIN genres g ON ig.genre_id = g.genre_id WHERE g.name = 'PROMO'""")
def filter_by_genre(m):
    g = m.genres().filter(F.col("name") == "PROMO")
    return A.with_genre_names(m.item_genres(), g).select("item_id", F.col("name").alias("genre"))


@register("recent_days_filter", f"""
SELECT user_id, item_id, rating, "timestamp" FROM ratings
WHERE "timestamp" >= (SELECT max("timestamp") FROM ratings) - {RECENT_DAYS} * 86400""")
def recent_days_filter(m):
    return A.recent_days_filter(m.ratings(), RECENT_DAYS, _max_ts(m))


@register("epoch_to_date", """
SELECT strftime(CAST(to_timestamp("timestamp") AS DATE), '%Y-%m-%d') AS day, count(*) AS num_ratings
FROM ratings GROUP BY 1""")
def epoch_to_date(m):
    return (m.ratings().groupBy(F.date_format(C.epoch_to_date("timestamp"), "yyyy-MM-dd").alias("day"))
            .agg(F.count(F.lit(1)).alias("num_ratings")))


@register("normalise_epoch", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN "timestamp" * 1000 ELSE "timestamp" END AS raw_ts,
       "timestamp" AS norm_ts FROM raw_tags""")
def normalise_epoch(m):
    t = m.table("events").select("event_id", C.ntz_to_epoch("ts").alias("ts"))
    raw = F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("ts") * 1000).otherwise(F.col("ts"))
    return t.select("event_id", raw.alias("raw_ts")).select("event_id", "raw_ts",
                                                            C.normalise_epoch("raw_ts").alias("norm_ts"))


@register("count_bucket", """
SELECT user_id, rating_count,
  CASE WHEN rating_count < 10 THEN '< 10 notes' WHEN rating_count < 50 THEN '10-49 notes'
       WHEN rating_count < 100 THEN '50-99 notes' WHEN rating_count < 500 THEN '100-499 notes'
       ELSE '500+ notes' END AS category
FROM (SELECT user_id, count(*) AS rating_count FROM ratings GROUP BY user_id) s""")
def count_bucket(m):
    c = m.ratings().groupBy("user_id").agg(F.count(F.lit(1)).alias("rating_count"))
    return c.select("user_id", "rating_count", C.count_bucket("rating_count").alias("category"))


_HIST_SQL = """
SELECT category, CAST(bucket_rank AS INTEGER) AS bucket_rank, count(*) AS {label} FROM (
  SELECT CASE WHEN rating_count < 10 THEN '< 10 notes' WHEN rating_count < 50 THEN '10-49 notes'
              WHEN rating_count < 100 THEN '50-99 notes' WHEN rating_count < 500 THEN '100-499 notes'
              ELSE '500+ notes' END AS category,
         CASE WHEN rating_count < 10 THEN 1 WHEN rating_count < 50 THEN 2 WHEN rating_count < 100 THEN 3
              WHEN rating_count < 500 THEN 4 ELSE 5 END AS bucket_rank
  FROM (SELECT {key}, count(*) AS rating_count FROM ratings GROUP BY {key}) s) b
GROUP BY category, bucket_rank ORDER BY bucket_rank"""


@register("bucket_order", _HIST_SQL.format(label="num_movies", key="item_id"))
def bucket_order(m):
    return A.item_count_histogram(m.ratings())


@register("damped_score", """
SELECT item_id, count(rating) AS num_ratings, avg(rating) AS avg_rating,
       sum(rating) / (count(rating) + 100) AS popularity_score FROM ratings GROUP BY item_id""")
def damped_score(m):
    return A.item_stats(m.ratings())


_DRIFT_SQL = f"""
, cur AS (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS num_users, CAST(count(DISTINCT item_id) AS DOUBLE) AS num_movies,
                 CAST(count(*) AS DOUBLE) AS num_ratings, coalesce(avg(rating), 0.0) AS avg_rating FROM ratings),
  base AS (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS num_users, CAST(count(DISTINCT item_id) AS DOUBLE) AS num_movies,
                  CAST(count(*) AS DOUBLE) AS num_ratings, coalesce(avg(rating), 0.0) AS avg_rating FROM ratings
           WHERE "timestamp" < (SELECT max("timestamp") FROM ratings) - {RECENT_DAYS} * 86400),
  lc AS (UNPIVOT cur ON avg_rating, num_users, num_movies, num_ratings INTO NAME metric VALUE current),
  lb AS (UNPIVOT base ON avg_rating, num_users, num_movies, num_ratings INTO NAME metric VALUE baseline),
  rows AS (SELECT lb.metric, lb.baseline, lc.current, abs((lc.current - lb.baseline) / lb.baseline * 100) AS raw
           FROM lb JOIN lc ON lb.metric = lc.metric WHERE lb.baseline <> 0)
"""


def _drift_rows(m):
    max_ts = _max_ts(m)
    r = m.ratings()
    base = A.data_statistics(r.filter(F.col("timestamp") < max_ts - RECENT_DAYS * 86400))
    return D.detect_drift(A.data_statistics(r), base, 10.0)


@register("change_pct", _DRIFT_SQL + "SELECT metric, round(raw, 2) AS change_pct FROM rows")
def change_pct(m):
    return _drift_rows(m).select("metric", "change_pct")


@register("status_label", _DRIFT_SQL
          + "SELECT metric, CASE WHEN raw > 10.0 THEN 'drift_detected' ELSE 'normal' END AS status FROM rows")
def status_label(m):
    return _drift_rows(m).select("metric", "status")


@register("null_to_zero", """
SELECT u.user_id, CAST(coalesce(n, 0) AS BIGINT) AS num_ratings, coalesce(a, 0.0) AS avg_rating, coalesce(lo, 0.0) AS min_rating
FROM users u LEFT JOIN (SELECT user_id, count(*) AS n, round(avg(rating), 6) AS a, min(rating) AS lo FROM ratings GROUP BY user_id) r
  ON u.user_id = r.user_id""")
def null_to_zero(m):
    """Statistics of every user; those without ratings have no group, so their NULLs fall back to 0."""
    per = m.ratings().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("rating").cast("double")), 6).alias("a"),
                                             F.min(F.col("rating").cast("double")).alias("lo"))
    return m.users().join(per, "user_id", "left").select(
        "user_id", C.null_to_zero("n", integral=True).alias("num_ratings"), C.null_to_zero("a").alias("avg_rating"), C.null_to_zero("lo").alias("min_rating"))


@register("rating_domain_check", """
SELECT coalesce(reason, 'valid') AS reason, count(*) AS num_rows FROM (
  SELECT CASE WHEN rating IS NULL THEN 'rating_null' WHEN rating < 0.5 OR rating > 5.0 THEN 'rating_out_of_range'
              WHEN u.user_id IS NULL THEN 'unknown_user' WHEN i.item_id IS NULL THEN 'unknown_item' END AS reason
  FROM (SELECT "userId" AS user_id, "movieId" AS item_id, CAST(round(e.value / 100, 1) AS DECIMAL(2,1)) AS rating
        FROM raw_tags r JOIN events e ON r.event_id = e.event_id) c
  LEFT JOIN users u ON c.user_id = u.user_id LEFT JOIN items i ON c.item_id = i.item_id) s
GROUP BY 1""")
def rating_domain_check(m):
    """Rating-like rows from request events (value / 100 as the rating) checked
    against the domain and both foreign keys; counts per reason."""
    e = m.table("events")
    n_items = m.table("part").select(F.count(F.lit(1))).scalar()
    cand = e.select(F.col("user_id"), F.pmod("event_id", n_items).alias("item_id"),
                    F.round(F.col("value") / 100, 1).cast("decimal(2,1)").alias("rating"),
                    C.ntz_to_epoch("ts").alias("timestamp"))
    checked = I.rating_domain_check(cand, m.users(), m.items())
    return (checked.groupBy(F.coalesce("reason", F.lit("valid")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("num_rows")))


@register("clip_to_scale", "SELECT event_id, greatest(0.5, least(5.0, value / 50)) AS est FROM events")
def clip_to_scale(m):
    return m.table("events").select("event_id", C.clip_to_scale(F.col("value") / 50).alias("est"))


@register("parse_iso_ts_filter", f"""
SELECT "timestamp", user_id FROM reco_log WHERE ts >= (SELECT max(ts) FROM reco_log) - INTERVAL {LOG_DAYS} DAY""")
def parse_iso_ts_filter(m):
    log = _log(m)
    as_of = log.select(F.max(C.parse_iso_ts("timestamp"))).scalar()
    return Q.recent_log(log, LOG_DAYS, as_of).select("timestamp", "user_id")


@register("nested_access", """
SELECT "timestamp", user_id, CAST(p AS INTEGER) AS pos, titles[p] AS movie, scores[p] AS score
FROM (SELECT *, unnest(range(1, len(titles) + 1)) AS p FROM reco_log) s""")
def nested_access(m):
    log = _log(m)
    return log.select("timestamp", "user_id", F.posexplode("recommendations").alias("pos", "r")).select(
        "timestamp", "user_id", (F.col("pos") + 1).alias("pos"), F.col("r.movie").alias("movie"),
        F.col("r.score").alias("score"))


@register("default_method", "SELECT coalesce(method, 'unknown') AS method, count(*) AS n FROM reco_log GROUP BY 1")
def default_method(m):
    return _log(m).groupBy(C.default_method("method").alias("method")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ joins ----
@register("filter_active_popular", f"""
SELECT r.user_id, r.item_id, r.rating FROM ratings r
WHERE r.user_id IN (SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) >= {MIN_USER})
  AND r.item_id IN (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) >= {MIN_ITEM})""")
def filter_active_popular(m):
    return A.filter_active_popular(m.ratings(), MIN_USER, MIN_ITEM)


@register("filter_active_popular_default", """
SELECT r.user_id, r.item_id, r.rating FROM ratings r
WHERE r.user_id IN (SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) >= 50)
  AND r.item_id IN (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) >= 100)""")
def filter_active_popular_default(m):
    """J1 with the reference thresholds (empty on the driver data)."""
    return A.filter_active_popular(m.ratings())


_POP_SQL = """
SELECT m.item_id, m.title, count(r.rating) AS num_ratings, avg(r.rating) AS avg_rating,
       sum(r.rating) / (count(r.rating) + 100) AS popularity_score
FROM items m LEFT JOIN ratings r ON m.item_id = r.item_id
GROUP BY m.item_id, m.title HAVING count(r.rating) >= 10"""


@register("items_left_ratings", _POP_SQL)
def items_left_ratings(m):
    return A.popularity_stats(m.ratings(), m.items(), 10)


@register("popularity_stats", _POP_SQL)
def popularity_stats(m):
    return A.popularity_stats(m.ratings(), m.items(), 10)


_POP_GENRE_SQL = """
, pop AS (""" + _POP_SQL + """)
, by_genre AS (SELECT g.name AS genre, p.item_id, p.title, p.num_ratings, p.avg_rating, p.popularity_score
               FROM pop p JOIN item_genres ig ON p.item_id = ig.item_id JOIN genres g ON ig.genre_id = g.genre_id)
"""


@register("items_genre_ratings", _POP_GENRE_SQL + "SELECT * FROM by_genre")
def items_genre_ratings(m):
    return A.popularity_by_genre(m.ratings(), m.items(), m.item_genres(), m.genres())


@register("popularity_by_genre", _POP_GENRE_SQL + "SELECT * FROM by_genre")
def popularity_by_genre(m):
    return A.popularity_by_genre(m.ratings(), m.items(), m.item_genres(), m.genres())


@register("ratings_genres", """
SELECT r.user_id, r.item_id, g.name AS genre FROM ratings r JOIN item_genres ig ON r.item_id = ig.item_id
JOIN genres g ON ig.genre_id = g.genre_id""")
def ratings_genres(m):
    ig = A.with_genre_names(m.item_genres(), m.genres())
    return m.ratings().join(ig, "item_id").select("user_id", "item_id", F.col("name").alias("genre"))


@register("ratings_titles", "SELECT r.user_id, r.item_id, m.title FROM ratings r JOIN items m ON r.item_id = m.item_id")
def ratings_titles(m):
    return A.ratings_with_titles(m.ratings(), m.items()).select("user_id", "item_id", "title")


@register("unrated_pairs", """
SELECT DISTINCT user_id, item_id FROM item_tags t
WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = t.user_id AND r.item_id = t.item_id)""")
def unrated_pairs(m):
    """Tagged (user, item) pairs without a rating."""
    return M.unrated_pairs(m.item_tags().select("user_id", "item_id").distinct(), m.ratings())


@register("set_minus_rated", """
SELECT "userId" AS user_id, "movieId" AS item_id FROM raw_tags
EXCEPT ALL SELECT user_id, item_id FROM ratings""")
def set_minus_rated(m):
    """Tag rows minus rated pairs with bag semantics (EXCEPT ALL)."""
    t = m.raw_tags().select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"))
    return t.exceptAll(m.ratings().select("user_id", "item_id"))


@register("genre_id_lookup", "SELECT item_id, genre_id FROM item_genres")
def genre_id_lookup(m):
    return m.item_genres()


@register("tag_id_lookup", 'SELECT user_id, item_id, tag_id, "timestamp" FROM item_tags')
def tag_id_lookup(m):
    return m.item_tags()


@register("referential_check", f"""
SELECT "userId" AS user_id, count(*) AS num_rows FROM raw_tags t
WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) >= {MIN_USER}) a WHERE a.user_id = t."userId") GROUP BY 1""")
def referential_check(m):
    """Tag rows whose user is missing from the table of active users, per user (against the full user table the
    driver data has no violation)."""
    t = m.raw_tags().withColumnRenamed("userId", "user_id")
    active = A.user_activity(m.ratings(), MIN_USER).select("user_id")
    return I.referential_check(t, active, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("num_rows"))


# ----------------------------------------------------------- aggregations ----
@register("user_activity", f"SELECT user_id, count(*) AS num_ratings FROM ratings GROUP BY user_id HAVING count(*) >= {MIN_USER}")
def user_activity(m):
    return A.user_activity(m.ratings(), MIN_USER)


@register("item_popularity", f"SELECT item_id, count(*) AS num_ratings FROM ratings GROUP BY item_id HAVING count(*) >= {MIN_ITEM}")
def item_popularity(m):
    return A.item_popularity(m.ratings(), MIN_ITEM)


@register("preferred_genres", """
SELECT r.user_id, g.name AS genre, avg(r.rating) AS avg_rating, count(r.rating) AS num_ratings
FROM ratings r JOIN item_genres ig ON r.item_id = ig.item_id JOIN genres g ON ig.genre_id = g.genre_id
GROUP BY r.user_id, g.name""")
def preferred_genres(m):
    return A.preferred_genres(m.ratings(), m.item_genres(), m.genres())


_STATS_SQL = """
SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS num_users, CAST(count(DISTINCT item_id) AS BIGINT) AS num_movies,
       count(*) AS num_ratings, coalesce(avg(rating), 0.0) AS avg_rating, coalesce(round(stddev_samp(rating), 6), 0.0) AS std_rating,
       coalesce(min(rating), 0.0) AS min_rating, coalesce(max(rating), 0.0) AS max_rating,
       CAST(count(DISTINCT CAST(to_timestamp("timestamp") AS DATE)) AS BIGINT) AS num_days{extra}
FROM ratings {where}"""


@register("data_statistics", _STATS_SQL.format(extra="", where=""))
def data_statistics(m):
    return A.data_statistics(m.ratings())


@register("recent_statistics", _STATS_SQL.format(
    extra=f", {RECENT_DAYS} AS period_days",
    where=f'WHERE "timestamp" >= (SELECT max("timestamp") FROM ratings) - {RECENT_DAYS} * 86400'))
def recent_statistics(m):
    return A.recent_statistics(m.ratings(), RECENT_DAYS, _max_ts(m))


@register("user_count_histogram", _HIST_SQL.format(label="num_users", key="user_id"))
def user_count_histogram(m):
    return A.user_count_histogram(m.ratings())


@register("item_count_histogram", _HIST_SQL.format(label="num_movies", key="item_id"))
def item_count_histogram(m):
    return A.item_count_histogram(m.ratings())


_IMPACT_SQL = """
, au AS (SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) >= {mu}),
  pm AS (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) >= {mi}),
  kept AS (SELECT count(*) AS n FROM ratings r JOIN au ON r.user_id = au.user_id JOIN pm ON r.item_id = pm.item_id)
SELECT {mu} AS min_user, {mi} AS min_item, (SELECT count(*) FROM ratings) AS total_ratings, kept.n AS filtered_ratings,
       round(kept.n / (SELECT count(*) FROM ratings) * 100, 2) AS pct_kept,
       (SELECT count(*) FROM au) AS filtered_users, (SELECT count(*) FROM pm) AS filtered_movies
FROM kept"""


@register("filter_impact", _IMPACT_SQL.format(mu=MIN_USER, mi=MIN_ITEM))
def filter_impact(m):
    return A.filter_impact(m.ratings(), MIN_USER, MIN_ITEM)


@register("filter_impact_default", _IMPACT_SQL.format(mu=50, mi=100))
def filter_impact_default(m):
    return A.filter_impact(m.ratings(), 50, 100)


SWEEP = ((10, 20), (20, 50), (30, 75), (20, 30), (30, 25))


def _sweep_sql(thresholds):
    parts = []
    for mu, mi in thresholds:
        parts.append(f"""SELECT {mu} AS min_user, {mi} AS min_item, count(*) AS filtered_ratings,
  round(count(*) / (SELECT count(*) FROM ratings) * 100, 2) AS pct_kept FROM ratings r
  WHERE r.user_id IN (SELECT user_id FROM ratings GROUP BY user_id HAVING count(*) >= {mu})
    AND r.item_id IN (SELECT item_id FROM ratings GROUP BY item_id HAVING count(*) >= {mi})""")
    return "\nUNION ALL\n".join(parts)


@register("filter_sweep", _sweep_sql(SWEEP))
def filter_sweep(m):
    """The reference's three alternative pairs plus two that keep rows on
    the driver data, in one pass."""
    return A.filter_sweep(m.ratings(), SWEEP)


@register("pct_kept", _sweep_sql(SWEEP))
def pct_kept(m):
    return A.filter_sweep(m.ratings(), SWEEP)


@register("table_totals", """
SELECT (SELECT count(*) FROM users) AS users, (SELECT count(*) FROM items) AS movies, count(*) AS ratings,
       round(avg(rating), 2) AS average_rating FROM ratings""")
def table_totals(m):
    return A.table_totals(m.users(), m.items(), m.ratings())


@register("distinct_counts", """
SELECT count(*) AS total_ratings, count(DISTINCT user_id) AS total_users, count(DISTINCT item_id) AS total_movies FROM ratings""")
def distinct_counts(m):
    return A.distinct_counts(m.ratings())


@register("is_new_user", f"""
SELECT u.user_id, NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = u.user_id) AS is_new
FROM (SELECT user_id FROM users UNION ALL SELECT {UNKNOWN_USER}) u""")
def is_new_user(m):
    return CS.is_new_user(_requested_users(m), m.ratings())


@register("is_new_item", f"""
SELECT i.item_id, NOT EXISTS (SELECT 1 FROM ratings r WHERE r.item_id = i.item_id) AS is_new
FROM (SELECT item_id FROM items UNION ALL SELECT {UNKNOWN_USER}) i""")
def is_new_item(m):
    extra = m.spark.range(1).select(F.lit(UNKNOWN_USER).cast("bigint").alias("item_id"))
    return CS.is_new_item(m.items().select("item_id").unionByName(extra), m.ratings())


@register("user_top_score", """
, best AS (SELECT user_id, max(s) AS top_score FROM (SELECT user_id, unnest(scores) AS s FROM reco_log) x GROUP BY user_id)
SELECT u.user_id, b.top_score FROM users u LEFT JOIN best b ON u.user_id = b.user_id""")
def user_top_score(m):
    lists = _log(m).select("user_id", F.explode(F.transform("recommendations", lambda r: r["score"])).alias("score"))
    return A.user_top_score(lists, m.users())


@register("distinct_users", "SELECT DISTINCT user_id FROM ratings")
def distinct_users(m):
    return I.distinct_users(m.ratings())


@register("distinct_tags", "SELECT DISTINCT tag FROM raw_tags WHERE tag IS NOT NULL")
def distinct_tags(m):
    return I.distinct_tags(m.raw_tags())


@register("distinct_genres", "SELECT DISTINCT genre AS name FROM item_genre_names")
def distinct_genres(m):
    return I.distinct_genres(m.raw_items())


@register("union_distinct_chunks", """
SELECT user_id FROM ratings WHERE "timestamp" < (SELECT median("timestamp") FROM ratings)
UNION SELECT user_id FROM ratings WHERE "timestamp" >= (SELECT median("timestamp") FROM ratings)""")
def union_distinct_chunks(m):
    """Distinct users over two halves of the ratings (split at the median day)."""
    r = m.ratings()
    mid = r.select(F.median("timestamp")).scalar()
    a = r.filter(F.col("timestamp") < mid).select("user_id")
    b = r.filter(F.col("timestamp") >= mid).select("user_id")
    return a.unionByName(b).distinct()


# -------------------------------------------------------- quality (log) ----
_POPULAR_TITLES_SQL = f"""
, popular AS (SELECT m.title FROM (SELECT item_id, count(*) AS n FROM ratings GROUP BY item_id HAVING count(*) >= {POPULAR_MIN}
                                   ORDER BY n DESC, item_id ASC LIMIT 100) t JOIN items m ON t.item_id = m.item_id),
  nov AS (SELECT event_id, count(*) FILTER (WHERE t NOT IN (SELECT title FROM popular)) AS novel
          FROM (SELECT event_id, unnest(titles) AS t FROM reco_log) x GROUP BY event_id),
  metrics AS (
    SELECT l.*, CASE WHEN len(titles) > 0 THEN round(len(list_distinct(titles)) / len(titles), 4) ELSE 0.0 END AS diversity,
           CASE WHEN len(titles) > 0 THEN round(coalesce(n.novel, 0) / len(titles), 4) ELSE 0.0 END AS novelty,
           CASE WHEN len(scores) > 0 THEN round(list_sum(scores) / len(scores), 4) ELSE 0.0 END AS avg_score, list_sum(scores) AS score_total,
           coalesce(round(list_max(scores), 4), 0.0) AS max_score, coalesce(round(list_min(scores), 4), 0.0) AS min_score,
           CAST(len(titles) AS INTEGER) AS list_size
    FROM reco_log l LEFT JOIN nov n ON l.event_id = n.event_id)
"""


def _metrics(m, novelty: bool = True):
    return Q.list_metrics(_log(m), Q.popular_titles(m.ratings(), m.items(), POPULAR_MIN, 100) if novelty else None)


@register("top_titles_by_count", f"""
SELECT t.item_id, m.title, t.n AS num_ratings FROM (SELECT item_id, count(*) AS n FROM ratings GROUP BY item_id
  HAVING count(*) >= {POPULAR_MIN} ORDER BY n DESC, item_id ASC LIMIT 100) t JOIN items m ON t.item_id = m.item_id""")
def top_titles_by_count(m):
    return A.top_titles_by_count(m.ratings(), m.items(), POPULAR_MIN, 100)


@register("diversity", _POPULAR_TITLES_SQL + 'SELECT "timestamp", user_id, diversity FROM metrics')
def diversity(m):
    return _metrics(m, novelty=False).select("timestamp", "user_id", "diversity")


@register("novelty", _POPULAR_TITLES_SQL + 'SELECT "timestamp", user_id, novelty FROM metrics')
def novelty(m):
    return _metrics(m).select("timestamp", "user_id", "novelty")


@register("not_in_popular", _POPULAR_TITLES_SQL + """
SELECT DISTINCT t AS title, t NOT IN (SELECT title FROM popular) AS is_novel FROM (SELECT unnest(titles) AS t FROM reco_log) x""")
def not_in_popular(m):
    """Every recommended title flagged against the popular set (left join
    on the bounded popular list + null test, never NOT IN)."""
    titles = _log(m).select(F.explode(F.transform("recommendations", lambda r: r["movie"])).alias("title")).distinct()
    pop = Q.popular_titles(m.ratings(), m.items(), POPULAR_MIN, 100).distinct().withColumn("_p", F.lit(True))
    return titles.join(F.broadcast(pop), "title", "left").select("title", F.col("_p").isNull().alias("is_novel"))


@register("list_metrics", _POPULAR_TITLES_SQL + """
SELECT "timestamp", user_id, diversity, novelty, avg_score, max_score, min_score, list_size AS num_recommendations FROM metrics""")
def list_metrics(m):
    return _metrics(m).select("timestamp", "user_id", "diversity", "novelty", "avg_score", "max_score", "min_score",
                              F.col("list_size").alias("num_recommendations"))


@register("round_metrics", _POPULAR_TITLES_SQL + 'SELECT "timestamp", user_id, avg_score FROM metrics')
def round_metrics(m):
    return _metrics(m, novelty=False).select("timestamp", "user_id", "avg_score")


@register("coverage", """
SELECT count(DISTINCT t) AS recommended_titles, (SELECT count(*) FROM items) AS total_movies,
       count(DISTINCT t) / (SELECT count(*) FROM items) AS coverage FROM (SELECT unnest(titles) AS t FROM reco_log) x""")
def coverage(m):
    return Q.coverage(_log(m), m.items())


@register("set_of_recommended", "SELECT DISTINCT unnest(titles) AS title FROM reco_log")
def set_of_recommended(m):
    return _log(m).select(F.explode(F.transform("recommendations", lambda r: r["movie"])).alias("title")).distinct()


@register("reco_statistics", _POPULAR_TITLES_SQL + f"""
, recent AS (SELECT * FROM metrics WHERE ts >= (SELECT max(ts) FROM reco_log) - INTERVAL {LOG_DAYS} DAY),
  meth AS (SELECT coalesce(method, 'unknown') AS method, count(*) AS n FROM recent GROUP BY 1)
SELECT count(*) AS total_recommendations, {LOG_DAYS} AS period_days,
       coalesce(((2 * sum(CAST(round(diversity * 10000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000.0, 0.0) AS avg_diversity,
       coalesce(((2 * sum(CAST(round(novelty * 10000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000.0, 0.0) AS avg_novelty,
       coalesce(round(sum(score_total) / sum(list_size), 4), 0.0) AS avg_score,
       coalesce((SELECT string_agg(method || ':' || CAST(n AS VARCHAR), ',' ORDER BY method || ':' || CAST(n AS VARCHAR)) FROM meth), '') AS methods_used
FROM recent""")
def reco_statistics(m):
    log = _log(m)
    as_of = log.select(F.max(C.parse_iso_ts("timestamp"))).scalar()
    recent = Q.recent_log(log, LOG_DAYS, as_of)
    pop = Q.popular_titles(m.ratings(), m.items(), POPULAR_MIN, 100)
    out = Q.reco_statistics(Q.list_metrics(recent, pop), LOG_DAYS)
    # the method counts are a map; the query shows them as sorted text
    text = F.array_join(F.transform(F.array_sort(F.map_entries("methods_used")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.withColumn("methods_used", F.coalesce(text, F.lit("")))


# ---------------------------------------------------------- top-k reports ----
@register("top_popular", _POP_SQL + " ORDER BY popularity_score DESC, num_ratings DESC, item_id ASC LIMIT 10")
def top_popular(m):
    return A.top_popular(m.ratings(), m.items(), 10, 10)


@register("top_genre_popular", _POP_GENRE_SQL + """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY genre ORDER BY popularity_score DESC, num_ratings DESC,
               item_id ASC) AS INTEGER) AS rank FROM by_genre) s WHERE rank <= 10""")
def top_genre_popular(m):
    return A.top_genre_popular(m.ratings(), m.items(), m.item_genres(), m.genres(), 10)


_USER_GENRES_SQL = """
, pg AS (SELECT r.user_id, g.name AS genre, avg(r.rating) AS avg_rating, count(r.rating) AS num_ratings
         FROM ratings r JOIN item_genres ig ON r.item_id = ig.item_id JOIN genres g ON ig.genre_id = g.genre_id
         GROUP BY r.user_id, g.name),
  tug AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY avg_rating DESC, num_ratings DESC,
                         genre ASC) AS INTEGER) AS genre_rank FROM pg) s WHERE genre_rank <= 3)
"""


@register("top_user_genres", _USER_GENRES_SQL + "SELECT * FROM tug")
def top_user_genres(m):
    return A.top_user_genres(m.ratings(), m.item_genres(), m.genres(), 3)


_COLD_SQL = _POP_GENRE_SQL + _USER_GENRES_SQL + f"""
, req AS (SELECT user_id FROM users UNION SELECT {UNKNOWN_USER}),
  prefs AS (SELECT t.*, greatest(2, CAST(floor(5 / count(*) OVER (PARTITION BY t.user_id)) AS INTEGER) + 1) AS quota
            FROM tug t WHERE t.user_id IN (SELECT user_id FROM req)),
  glists AS (SELECT * FROM (SELECT genre, item_id, title AS movie, popularity_score AS score,
                   row_number() OVER (PARTITION BY genre ORDER BY popularity_score DESC, num_ratings DESC, item_id ASC) AS genre_pos
                   FROM by_genre) s WHERE genre_pos <= 6),
  merged AS (SELECT p.user_id, p.genre_rank, l.genre_pos, l.item_id, l.movie, l.score FROM prefs p JOIN glists l
             ON p.genre = l.genre WHERE l.genre_pos <= p.quota),
  genre_rows AS (SELECT user_id, rank, item_id, movie, score, 'genres' AS method FROM (
                 SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, genre_rank ASC, genre_pos ASC)
                        AS INTEGER) AS rank
                 FROM merged) s WHERE rank <= 5),
  top AS (SELECT item_id, title AS movie, popularity_score AS score,
                 CAST(row_number() OVER (ORDER BY popularity_score DESC, num_ratings DESC, item_id ASC) AS INTEGER) AS rank
          FROM pop QUALIFY rank <= 5),
  pop_rows AS (SELECT q.user_id, t.rank, t.item_id, t.movie, t.score, 'popular' AS method
               FROM req q JOIN top t ON true WHERE q.user_id NOT IN (SELECT user_id FROM prefs))
"""


@register("cold_start", _COLD_SQL + "SELECT * FROM genre_rows UNION ALL SELECT * FROM pop_rows")
def cold_start(m):
    return CS.cold_start(_requested_users(m), m.ratings(), m.items(), m.item_genres(), m.genres(), 5, 3, 10)


@register("merge_genre_lists", _COLD_SQL + "SELECT * FROM genre_rows")
def merge_genre_lists(m):
    """T4: the genre branch of the cold-start lists (duplicates kept)."""
    out = CS.cold_start(_requested_users(m), m.ratings(), m.items(), m.item_genres(), m.genres(), 5, 3, 10)
    return out.filter(F.col("method") == "genres")


@register("union_all_lists", _COLD_SQL + "SELECT user_id, count(*) AS n FROM (SELECT * FROM genre_rows UNION ALL SELECT * FROM pop_rows) s GROUP BY user_id")
def union_all_lists(m):
    """List sizes after the union of both branches."""
    out = CS.cold_start(_requested_users(m), m.ratings(), m.items(), m.item_genres(), m.genres(), 5, 3, 10)
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@register("topn_per_user", """
SELECT user_id, item_id, rating, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id
       ORDER BY rating DESC, "timestamp" DESC, item_id ASC) AS INTEGER) AS rank FROM ratings) s WHERE rank <= 5""")
def topn_per_user(m):
    """T5 on a fixed score table: each user's five best-rated items."""
    w = Window.partitionBy("user_id").orderBy(F.col("rating").desc(), F.col("timestamp").desc(), F.col("item_id").asc())
    # dealt by user first: a user's ratings lie in many files, so a limit before the shuffle would sort everything and drop little
    return (m.ratings().repartition("user_id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5)
            .select("user_id", "item_id", "rating", "rank"))


@register("title_lookup", """
SELECT s.user_id, s.rank, s.item_id, m.title AS movie FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id
       ORDER BY rating DESC, "timestamp" DESC, item_id ASC) AS INTEGER) AS rank FROM ratings) s JOIN items m ON s.item_id = m.item_id
WHERE s.rank <= 5""")
def title_lookup(m):
    """Titles joined after the per-user rank filter."""
    top = topn_per_user(m)
    return top.join(m.items().select("item_id", F.col("title").alias("movie")), "item_id").select(
        "user_id", "rank", "item_id", "movie")


@register("latest_rows", """
SELECT user_id, item_id, rating, "timestamp" FROM ratings ORDER BY "timestamp" DESC, user_id ASC, item_id ASC LIMIT 10000""")
def latest_rows(m):
    return A.latest_rows(m.ratings(), 10000)


@register("random_rows", f"""
SELECT r.user_id, r.item_id, r.rating, r."timestamp", i.title FROM (SELECT * FROM ratings ORDER BY {_hash_sql("user_id, item_id", 42)}, user_id, item_id LIMIT 10) r
JOIN items i ON r.item_id = i.item_id""")
def random_rows(m):
    return M.random_rows(m.ratings(), m.items(), 10, 42)


@register("limit_rows", 'SELECT user_id, item_id, rating, "timestamp" FROM ratings ORDER BY user_id, item_id LIMIT 10000')
def limit_rows(m):
    return M.limit_rows(m.ratings(), 10000, ["user_id", "item_id"])


# --------------------------------------------------------------- sampling ----
@register("sample_n", f"""SELECT user_id, item_id, rating, "timestamp" FROM ratings ORDER BY {_hash_sql("user_id, item_id", 0)}, user_id, item_id LIMIT 5000""")
def sample_n(m):
    """M1: 5,000 rows (the reference's 100,000 is more than sf0.01 holds, so nothing would be sampled)."""
    return M.sample_n(m.ratings(), 5000, ["user_id", "item_id"], 0)


@register("sample_n_seeded", f"""SELECT user_id, item_id, rating, "timestamp" FROM ratings ORDER BY {_hash_sql("user_id, item_id", 42)}, user_id, item_id LIMIT 4000""")
def sample_n_seeded(m):
    """M2: 4,000 rows with seed 42 (the reference's 2,000,000 would keep everything here)."""
    return M.sample_n(m.ratings(), 4000, ["user_id", "item_id"], 42)


@register("random_ids", f"SELECT user_id FROM users ORDER BY {_hash_sql('user_id', 0)}, user_id LIMIT 500")
def random_ids(m):
    return M.random_ids(m.users(), "user_id", 500, 0)


@register("kfold", f"SELECT CAST({_hash_sql("user_id, item_id", 0)} % 3 AS INTEGER) AS fold, user_id, item_id, rating FROM ratings")
def kfold(m):
    return M.kfold(m.ratings(), ["user_id", "item_id"], 3, 0).select("fold", "user_id", "item_id", "rating")


@register("cap_sample", f"""SELECT user_id, item_id, rating, "timestamp" FROM ratings ORDER BY {_hash_sql("user_id, item_id", 7)}, user_id, item_id LIMIT 10000""")
def cap_sample(m):
    return M.sample_n(m.ratings(), 10000, ["user_id", "item_id"], 7)


@register("generate_ratings", f"""
, gu AS (SELECT user_id FROM users ORDER BY {_hash_sql('user_id', 0)}, user_id LIMIT 500),
  gi AS (SELECT item_id FROM items ORDER BY {_hash_sql('item_id', 1)}, item_id LIMIT 500),
  fresh AS (SELECT gu.user_id, gi.item_id FROM gu, gi WHERE NOT EXISTS (
              SELECT 1 FROM ratings r WHERE r.user_id = gu.user_id AND r.item_id = gi.item_id))
SELECT user_id, item_id, ({_hash_sql('user_id, item_id', 0)} % 10 + 1) * 0.5::DOUBLE AS rating,
       (SELECT max("timestamp") FROM ratings) + 86400 AS "timestamp"
FROM fresh ORDER BY {_hash_sql('user_id, item_id', 0)}, user_id, item_id LIMIT 10000""")
def generate_ratings(m):
    return M.generate_ratings(m.users(), m.items(), m.ratings(), 10000, 0, 500, _max_ts(m) + 86400)


@register("random_rating", f"SELECT user_id, item_id, ({_hash_sql("user_id, item_id", 3)} % 10 + 1) * 0.5::DOUBLE AS rating FROM ratings")
def random_rating(m):
    return m.ratings().select("user_id", "item_id", C.random_rating(3).alias("rating"))


# ------------------------------------------------------------------ drift ----
@register("detect_drift", _DRIFT_SQL + """
SELECT metric, baseline, current, round(raw, 2) AS change_pct,
       CASE WHEN raw > 10.0 THEN 'drift_detected' ELSE 'normal' END AS status FROM rows""")
def detect_drift(m):
    return _drift_rows(m)


def _ks_samples(m):
    r = m.ratings()
    oldest = A.oldest_rows(r, 10000)
    latest = A.latest_rows(r, 10000)
    return oldest, latest


def _ks_sql(select: str) -> str:
    terms = " + ".join(f"({(-1.0) ** (k - 1)!r}) * exp({-2.0 * k * k!r} * lam * lam)" for k in range(1, D.KS_TERMS + 1))
    return f"""
, a AS (SELECT * FROM ratings ORDER BY "timestamp" ASC, user_id ASC, item_id ASC LIMIT 10000),
  b AS (SELECT * FROM ratings ORDER BY "timestamp" DESC, user_id ASC, item_id ASC LIMIT 10000),
  la AS (UNPIVOT (SELECT CAST(user_id AS DOUBLE) AS user_id, CAST(item_id AS DOUBLE) AS item_id, CAST(rating AS DOUBLE) AS rating,
                         CAST("timestamp" AS DOUBLE) AS "timestamp" FROM a) ON user_id, item_id, rating, "timestamp" INTO NAME "column" VALUE value),
  lb AS (UNPIVOT (SELECT CAST(user_id AS DOUBLE) AS user_id, CAST(item_id AS DOUBLE) AS item_id, CAST(rating AS DOUBLE) AS rating,
                         CAST("timestamp" AS DOUBLE) AS "timestamp" FROM b) ON user_id, item_id, rating, "timestamp" INTO NAME "column" VALUE value),
  counts AS (SELECT "column", value, sum(ca) AS ca, sum(cb) AS cb FROM (
               SELECT "column", value, 1 AS ca, 0 AS cb FROM la UNION ALL SELECT "column", value, 0, 1 FROM lb) s GROUP BY 1, 2),
  cdf AS (SELECT "column",
                 sum(ca) OVER (PARTITION BY "column" ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(ca) OVER (PARTITION BY "column") AS fa,
                 sum(cb) OVER (PARTITION BY "column" ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(cb) OVER (PARTITION BY "column") AS fb,
                 sum(ca) OVER (PARTITION BY "column") AS n_a, sum(cb) OVER (PARTITION BY "column") AS n_b FROM counts),
  d AS (SELECT "column", max(abs(fa - fb)) AS ks_raw, CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b FROM cdf GROUP BY 1),
  lamt AS (SELECT *, (sqrt(n_a * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b))) * ks_raw AS lam FROM d),
  ks AS (SELECT "column", round(ks_raw, 10) AS ks_stat, n_a, n_b,
                round(CASE WHEN ks_raw <= 0 OR lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2.0 * ({terms}))) END, 6) AS p_value
         FROM lamt)
{select}"""


@register("ks_drift", _ks_sql('SELECT "column", ks_stat, n_a, n_b, p_value, p_value < 0.05 AS drift_detected FROM ks'))
def ks_drift(m):
    a, b = _ks_samples(m)
    return D.ks_drift(a, b, ["user_id", "item_id", "rating", "timestamp"], 0.05)


@register("drift_summary", _ks_sql("""
SELECT count(*) FILTER (WHERE p_value < 0.05) AS drifted_columns, count(*) AS columns_tested,
       max(n_a) AS baseline_size, max(n_b) AS current_size, count(*) FILTER (WHERE p_value < 0.05) > 0 AS drift_detected FROM ks"""))
def drift_summary(m):
    a, b = _ks_samples(m)
    return D.drift_summary(D.ks_drift(a, b, None, 0.05))


@register("drifted_columns", _ks_sql("SELECT count(*) FILTER (WHERE p_value < 0.05) AS drifted_columns FROM ks"))
def drifted_columns(m):
    a, b = _ks_samples(m)
    return D.drift_summary(D.ks_drift(a, b, None, 0.05)).select("drifted_columns")


_QUARTER_SQL = """
, q AS (SELECT *, date_trunc('quarter', to_timestamp("timestamp") AT TIME ZONE 'UTC') AS qq, year(to_timestamp("timestamp") AT TIME ZONE 'UTC') AS yy FROM ratings),
  cur AS (SELECT strftime(qq, '%Y-%m-%d') AS period, min("timestamp") AS since, avg(rating) AS avg_rating, count(DISTINCT user_id) AS num_users, count(DISTINCT item_id) AS num_movies,
                 count(*) AS num_ratings FROM q GROUP BY qq),
  snap AS (SELECT yy, max("timestamp") AS as_of, avg(rating) AS avg_rating, count(DISTINCT user_id) / 4 AS num_users, count(DISTINCT item_id) / 4 AS num_movies, count(*) / 4 AS num_ratings FROM q GROUP BY yy),
  j AS (SELECT c.*, s.as_of, s.avg_rating AS a1, s.num_users AS a2, s.num_movies AS a3, s.num_ratings AS a4 FROM cur c ASOF LEFT JOIN snap s ON c.since > s.as_of)
"""


@register("baseline_bootstrap", _QUARTER_SQL + """
, m AS (SELECT period, as_of, CAST(coalesce(a1 <> 0, false) AS INTEGER) + CAST(coalesce(a2 <> 0, false) AS INTEGER) + CAST(coalesce(a3 <> 0, false) AS INTEGER) + CAST(coalesce(a4 <> 0, false) AS INTEGER) AS k,
          CAST(coalesce(abs((avg_rating - a1) / a1 * 100) > 10.0, false) AS INTEGER) + CAST(coalesce(abs((num_users - a2) / a2 * 100) > 10.0, false) AS INTEGER)
        + CAST(coalesce(abs((num_movies - a3) / a3 * 100) > 10.0, false) AS INTEGER) + CAST(coalesce(abs((num_ratings - a4) / a4 * 100) > 10.0, false) AS INTEGER) AS d FROM j)
SELECT 'ratings' AS dataset, period, CASE WHEN as_of IS NULL THEN 'baseline_created' ELSE 'compared' END AS status, as_of AS baseline_version, k AS metrics_checked,
       d AS metrics_drifted, d > 0 AS drift_detected FROM m""")
def baseline_bootstrap(m):
    """Every quarter of the ratings against the versioned baseline as of its start (a snapshot per finished year, its
    counts per quarter); quarters before the first snapshot become the baseline and report no drift."""
    r = m.ratings()
    at = F.timestamp_seconds("timestamp")
    yearly = D.period_statistics(r, F.year(at)).select(F.lit("ratings").alias("dataset"), "as_of", "avg_rating",
                                                       *[(F.col(c) / 4).alias(c) for c in ("num_users", "num_movies", "num_ratings")])
    path = scratch_path(m.spark, "baselines")
    W.save_snapshots(yearly, path)
    quarters = D.period_statistics(r, F.date_format(F.date_trunc("quarter", at), "yyyy-MM-dd")).withColumn("dataset", F.lit("ratings"))
    return D.baseline_checks(quarters, W.load_snapshots(m.spark, path))


@register("drift_with_fallback", _ks_sql("""
, lim AS (SELECT count(*) FILTER (WHERE p_value < 0.05) AS drifted, count(*) AS checked FROM ks),
  sa AS (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS num_users, CAST(count(DISTINCT item_id) AS DOUBLE) AS num_movies, CAST(count(*) AS DOUBLE) AS num_ratings, avg(rating) AS avg_rating FROM a),
  sb AS (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS num_users, CAST(count(DISTINCT item_id) AS DOUBLE) AS num_movies, CAST(count(*) AS DOUBLE) AS num_ratings, avg(rating) AS avg_rating FROM b),
  ua AS (UNPIVOT sa ON avg_rating, num_users, num_movies, num_ratings INTO NAME metric VALUE x),
  ub AS (UNPIVOT sb ON avg_rating, num_users, num_movies, num_ratings INTO NAME metric VALUE y),
  st AS (SELECT count(*) FILTER (WHERE abs((y - x) / x * 100) > 10.0) AS drifted, count(*) AS checked FROM ua JOIN ub USING (metric) WHERE x <> 0)
SELECT 'ks' AS asked, 'ks' AS method, drifted, checked, drifted > 0 AS drift_detected FROM lim
UNION ALL SELECT 'stats', 'stats', drifted, checked, drifted > 0 FROM st
UNION ALL SELECT 'ks without baseline rows', 'stats', 0, 0, false"""))
def drift_with_fallback(m):
    """The verdict of both methods, and of the distributional one without baseline rows, which falls back."""
    a, b = _ks_samples(m)
    asked = [("ks", a, "ks"), ("stats", a, "stats"), ("ks without baseline rows", a.limit(0), "ks")]
    parts = [D.drift_with_fallback(base, b, method).withColumn("asked", F.lit(name)) for name, base, method in asked]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("asked", "method", "drifted", "checked", "drift_detected")


# ------------------------------------------------------------ more sinks ----
@register("append_reco_log", """
SELECT user_id, method, num_recommendations FROM reco_log""")
def append_reco_log(m):
    """Log lines appended in two writes (two halves of the events) and
    scanned back: row shape of the stored log."""
    path = scratch_path(m.spark, "reco-log-append")
    entries = Q.log_entries_from_events(m.events(), m.items())
    mid = m.events().select(F.median("event_id")).scalar()
    Q.append_reco_log(entries.filter(F.col("event_id") < mid), path)
    Q.append_reco_log(entries.filter(F.col("event_id") >= mid), path)
    return Q.scan_reco_log(m.spark, path).select("user_id", "method", "num_recommendations")


@register("load_if_empty", "SELECT count(*) AS num_ratings, 1 AS loads FROM ratings")
def load_if_empty(m):
    """The load runs for an empty target only: a second attempt is skipped."""
    spark = m.spark
    target = scratch_path(spark, "load-if-empty")
    loads = 0
    for _ in range(2):
        loads += W.load_if_empty(target, lambda p: m.ratings().write.mode("append").parquet(p), spark)
    return spark.read.parquet(target).agg(F.count(F.lit(1)).alias("num_ratings")).withColumn("loads", F.lit(loads))


@register("load_baseline_stats", _STATS_SQL.format(extra=", '2000-01-01T00:00:00.000000' AS \"timestamp\"", where=""))
def load_baseline_stats(m):
    path = scratch_path(m.spark, "baseline-stats")
    W.save_baseline_stats(A.data_statistics(m.ratings()), path, "2000-01-01T00:00:00.000000")
    return W.load_baseline_stats(m.spark, path)


@register("save_baseline_stats", _STATS_SQL.format(extra=", '2000-01-01T00:00:00.000000' AS \"timestamp\"", where=""))
def save_baseline_stats(m):
    path = scratch_path(m.spark, "baseline-stats-save")
    W.save_baseline_stats(A.data_statistics(m.ratings()), path, "2000-01-01T00:00:00.000000")
    return m.spark.read.schema(S.BASELINE_STATS).json(path)


@register("save_baseline_rows", """
SELECT user_id, item_id, rating, "timestamp" FROM ratings ORDER BY "timestamp" DESC, user_id ASC, item_id ASC LIMIT 10000""")
def save_baseline_rows(m):
    """The current sample (latest 10,000 ratings) stored as baseline rows."""
    path = scratch_path(m.spark, "baseline-rows-save")
    W.save_baseline_rows(A.latest_rows(m.ratings(), 10000), path)
    return W.load_baseline_rows(m.spark, path)


@register("write_drift_report", _DRIFT_SQL + """
SELECT metric, baseline, current, round(raw, 2) AS change_pct,
       CASE WHEN raw > 10.0 THEN 'drift_detected' ELSE 'normal' END AS status FROM rows""")
def write_drift_report(m):
    path = scratch_path(m.spark, "drift-report")
    W.write_drift_report(_drift_rows(m), path)
    return m.spark.read.schema("metric string, baseline double, current double, change_pct double, status string").json(path)


# ----------------------------------------------------- pair-free join keys ----
@register("candidate_pairs", """
SELECT u.user_id, (SELECT count(*) FROM items) - count(i.item_id) AS candidates
FROM users u LEFT JOIN ratings r ON u.user_id = r.user_id LEFT JOIN items i ON r.item_id = i.item_id GROUP BY u.user_id""")
def candidate_pairs(m):
    """J11 size per user: unseen items = catalogue size - rated items of the catalogue. The pairs of all users are never
    materialised (R8 scores them in blocks)."""
    n_items = m.items().select(F.count(F.lit(1))).scalar()
    rated = m.ratings().join(m.items().select("item_id"), "item_id", "left_semi").groupBy("user_id").agg(F.count(F.lit(1)).alias("_rated"))
    return (m.users().join(rated, "user_id", "left")
            .select("user_id", (n_items - F.coalesce("_rated", F.lit(0))).alias("candidates")))


@register("candidate_pairs_bounded", f"""
, cu AS (SELECT user_id FROM users ORDER BY {_hash_sql('user_id', 3)}, user_id LIMIT 50)
SELECT user_id, item_id FROM cu, items i WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = cu.user_id AND r.item_id = i.item_id)""")
def candidate_pairs_bounded(m):
    """J11 as pairs: for 50 sampled users every catalogue item that they have not rated. The users travel as one bounded
    array exploded per item."""
    ids = M.random_ids(m.users(), "user_id", 50, 3).agg(F.collect_list("user_id").alias("ids")).select("ids").scalar()
    return M.unrated_pairs(m.items().select(F.explode(ids).alias("user_id"), "item_id"), m.ratings())


@register("cross_user_item", f"""
, gu AS (SELECT user_id FROM users ORDER BY {_hash_sql('user_id', 0)}, user_id LIMIT 500),
  gi AS (SELECT item_id FROM items ORDER BY {_hash_sql('item_id', 1)}, item_id LIMIT 500),
  n AS (SELECT count(*) AS rated FROM ratings r WHERE r.user_id IN (SELECT user_id FROM gu) AND r.item_id IN (SELECT item_id FROM gi))
SELECT (SELECT count(*) FROM gu) AS sampled_users, (SELECT count(*) FROM gi) AS sampled_items, rated AS rated_in_grid,
       (SELECT count(*) FROM gu) * (SELECT count(*) FROM gi) - rated AS unrated_pairs FROM n""")
def cross_user_item(m):
    """J6 + J7 as counts: of the 500 sampled users x 500 sampled items, how many
    pairs are unrated (grid size minus the rated pairs inside the grid, found by
    two semi-joins), without building the grid."""
    u = M.random_ids(m.users(), "user_id", 500, 0)
    i = M.random_ids(m.items(), "item_id", 500, 1)
    inside = m.ratings().join(u, "user_id", "left_semi").join(F.broadcast(i), "item_id", "left_semi")
    nu = u.select(F.count(F.lit(1))).scalar()
    ni = i.select(F.count(F.lit(1))).scalar()
    return inside.agg(F.count(F.lit(1)).alias("rated_in_grid")).select(
        nu.alias("sampled_users"), ni.alias("sampled_items"), "rated_in_grid",
        (nu * ni - F.col("rated_in_grid")).alias("unrated_pairs"))


_SCHEMA_SQL = """
, cells AS (SELECT date_trunc('day', ts) AS d, date_trunc('hour', ts) AS h, event_type AS name, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) = regexp_replace(CAST(value AS VARCHAR), '\\.0+$', '') AS whole
            FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL),
  cur AS (SELECT d, h, name, CASE WHEN bool_and(whole) THEN 'bigint' ELSE 'double' END AS type FROM cells GROUP BY ALL),
  days AS (SELECT d, lag(d) OVER (ORDER BY d) AS prev FROM (SELECT DISTINCT d FROM cells) x),
  base AS (SELECT d, name, CASE WHEN bool_and(whole) THEN 'bigint' ELSE 'double' END AS type FROM cells GROUP BY ALL),
  hours AS (SELECT DISTINCT h, prev FROM cells JOIN days USING (d)),
  b AS (SELECT h, name, type FROM hours JOIN base ON base.d = hours.prev),
  f AS (SELECT coalesce(b.h, c.h) AS h, coalesce(b.name, c.name) AS name, b.type AS was, c.type AS is_ FROM b FULL JOIN (SELECT h, name, type FROM cur) c ON b.h = c.h AND b.name = c.name),
  g AS (SELECT h, count(was) AS baseline_columns, count(is_) AS current_columns, coalesce(string_agg(CASE WHEN was IS NULL THEN name END, ',' ORDER BY name), '') AS added,
          coalesce(string_agg(CASE WHEN is_ IS NULL THEN name END, ',' ORDER BY name), '') AS missing, coalesce(string_agg(CASE WHEN was <> is_ THEN name END, ',' ORDER BY name), '') AS type_changed FROM f GROUP BY h)
SELECT strftime(h, '%Y-%m-%d %H') AS period, CASE WHEN prev IS NULL THEN 'baseline_created' ELSE 'compared' END AS status, baseline_columns, current_columns,
  CASE WHEN prev IS NULL THEN '' ELSE added END AS added, missing, type_changed, prev IS NOT NULL AND added || missing || type_changed <> '' AS drift_detected
FROM g JOIN hours USING (h)"""


@register("schema_drift", _SCHEMA_SQL)
def schema_drift(m):
    """D6 over the request events: an hour's schema is the event types that deliver a value, with the narrowest type of their
    values; it is compared with the snapshot as of the hour, the schema of the latest earlier day."""
    events = m.events().select(F.date_trunc("day", "ts").alias("day"), F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("name"),
                               F.regexp_replace(F.col("value").cast("string"), r"\.0+$", "").alias("value")).filter("name is not null")
    events = events.filter("value is not null")
    path = scratch_path(m.spark, "schemas")
    daily = D.observed_schema(events.withColumn("as_of", F.unix_timestamp("day")), ["as_of"]).withColumn("dataset", F.lit("events"))
    W.save_snapshots(daily, path)
    versions = W.load_snapshots(m.spark, path)
    hours = events.select("hour", F.unix_timestamp("day").alias("since"), F.lit("events").alias("dataset")).distinct()
    checks = D.as_of(hours, versions.select("dataset", "as_of").distinct()).select("hour", "dataset", "baseline_version")
    base = checks.join(versions.withColumnRenamed("as_of", "baseline_version"), ["dataset", "baseline_version"]).select("hour", "name", "type")
    changes = D.schema_changes(D.observed_schema(events, ["hour"]), base, ["hour"]).join(checks, "hour")
    first = F.col("baseline_version").isNull()
    return changes.select(F.date_format("hour", "yyyy-MM-dd HH").alias("period"), F.when(first, "baseline_created").otherwise("compared").alias("status"), "baseline_columns",
                          "current_columns", F.when(first, "").otherwise(F.col("added")).alias("added"), "missing", "type_changed", (~first & F.col("drift_detected")).alias("drift_detected"))


# ------------------------------------------------- one genre, one user, bounded grids ----
@register("popularity_one_genre", _POP_GENRE_SQL + "SELECT * FROM by_genre WHERE genre = (SELECT min(name) FROM genres)")
def popularity_one_genre(m):
    """A4 of a single genre (the first by name)."""
    name = m.genres().agg(F.min("name")).first()[0]
    return A.popularity_by_genre(m.ratings(), m.items(), m.item_genres(), m.genres(), name)


@register("random_rows_one_user", f"""
SELECT r.user_id, r.item_id, r.rating, r."timestamp", i.title FROM (SELECT * FROM ratings WHERE user_id = (SELECT min(user_id) FROM ratings)
  ORDER BY {_hash_sql("user_id, item_id", 42)}, user_id, item_id LIMIT 10) r JOIN items i ON r.item_id = i.item_id""")
def random_rows_one_user(m):
    """T8 of a single user (the smallest id with ratings)."""
    return M.random_rows(m.ratings(), m.items(), 10, 42, m.ratings().agg(F.min("user_id")).first()[0])


_GRID_SQL = f"""
, gu AS (SELECT user_id FROM users ORDER BY {_hash_sql('user_id', 0)}, user_id LIMIT 500),
  gi AS (SELECT item_id FROM items ORDER BY {_hash_sql('item_id', 1)}, item_id LIMIT 500)
SELECT user_id, item_id FROM gu, gi WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = gu.user_id AND r.item_id = gi.item_id)"""


@register("unrated_grid", _GRID_SQL)
def unrated_grid(m):
    """J6 + J7 as pairs: the 500 sampled users with the 500 sampled items, without the rated pairs. The item sample is one
    bounded array exploded per user, not a join."""
    u = M.random_ids(m.users(), "user_id", 500, 0)
    ids = M.random_ids(m.items(), "item_id", 500, 1).agg(F.collect_list("item_id").alias("ids")).select("ids").scalar()
    return M.unrated_pairs(u.select("user_id", F.explode(ids).alias("item_id")), m.ratings())


@register("data_statistics_approx")
def data_statistics_approx(m):
    """A6 with HyperLogLog distinct counts (no shuffle of user/item keys);
    approximate, so checked on rows only."""
    return A.data_statistics(m.ratings(), approx=True)
