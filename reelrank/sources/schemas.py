"""Explicit schemas: raw CSV files, normalised tables, logs and reports.

Types are never inferred (inference costs a full extra pass and loses the
leading zeros of link ids).
"""

from pyspark.sql import types as T

RATING = T.DecimalType(2, 1)
RELEVANCE = T.DecimalType(10, 6)


def _s(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# Raw CSV files (header row, comma separated, double quotes).
CSV_ITEMS = _s(("movieId", T.LongType(), False), ("title", T.StringType(), False),
               ("genres", T.StringType(), True))
CSV_RATINGS = _s(("userId", T.LongType(), False), ("movieId", T.LongType(), False),
                 ("rating", RATING, True), ("timestamp", T.LongType(), True))
CSV_TAGS = _s(("userId", T.LongType(), False), ("movieId", T.LongType(), False),
              ("tag", T.StringType(), True), ("timestamp", T.LongType(), True))
CSV_LINKS = _s(("movieId", T.LongType(), False), ("imdbId", T.StringType(), True),
               ("tmdbId", T.StringType(), True))
CSV_GENOME_TAGS = _s(("tagId", T.LongType(), False), ("tag", T.StringType(), False))
CSV_GENOME_SCORES = _s(("movieId", T.LongType(), False), ("tagId", T.LongType(), False),
                       ("relevance", RELEVANCE, True))

# Renames from the raw files to the normalised tables.
RENAMES = {
    "items": {"movieId": "item_id"},
    "ratings": {"userId": "user_id", "movieId": "item_id"},
    "tags": {"userId": "user_id", "movieId": "item_id"},
    "links": {"movieId": "item_id", "imdbId": "imdb_id", "tmdbId": "tmdb_id"},
    "genome_tags": {"tagId": "tag_id"},
    "genome_scores": {"movieId": "item_id", "tagId": "tag_id"},
}

# Normalised tables (keys in comments).
GENRES = _s(("genre_id", T.LongType(), False), ("name", T.StringType(), False))  # genre_id; name unique
ITEMS = _s(("item_id", T.LongType(), False), ("title", T.StringType(), False),
           ("release_year", T.IntegerType(), True))  # item_id
ITEM_GENRES = _s(("item_id", T.LongType(), False), ("genre_id", T.LongType(), False))
USERS = _s(("user_id", T.LongType(), False),)
RATINGS = _s(("user_id", T.LongType(), False), ("item_id", T.LongType(), False),
             ("rating", RATING, False), ("timestamp", T.LongType(), False))  # (user_id, item_id)
TAGS = _s(("tag_id", T.LongType(), False), ("tag", T.StringType(), False))
ITEM_TAGS = _s(("user_id", T.LongType(), False), ("item_id", T.LongType(), False),
               ("tag_id", T.LongType(), False), ("timestamp", T.LongType(), True))
GENOME_TAGS = _s(("tag_id", T.LongType(), False), ("tag", T.StringType(), False))
GENOME_SCORES = _s(("item_id", T.LongType(), False), ("tag_id", T.LongType(), False),
                   ("relevance", RELEVANCE, True))
LINKS = _s(("item_id", T.LongType(), False), ("imdb_id", T.StringType(), True),
           ("tmdb_id", T.StringType(), True))

PRIMARY_KEYS = {
    "genres": ["genre_id"], "items": ["item_id"], "item_genres": ["item_id", "genre_id"],
    "users": ["user_id"], "ratings": ["user_id", "item_id"], "tags": ["tag_id"],
    "item_tags": ["user_id", "item_id", "tag_id"], "genome_tags": ["tag_id"],
    "genome_scores": ["item_id", "tag_id"], "links": ["item_id"],
}

# Recommendation log line (JSON).
RECO_ENTRY = _s(("movie", T.StringType(), True), ("score", T.DoubleType(), True))
RECO_LOG = _s(("timestamp", T.StringType(), True), ("user_id", T.LongType(), True),
              ("method", T.StringType(), True), ("num_recommendations", T.IntegerType(), True),
              ("recommendations", T.ArrayType(RECO_ENTRY), True))
RECO_LOG_WITH_CORRUPT = T.StructType(RECO_LOG.fields + [T.StructField("_corrupt_record", T.StringType(), True)])

# Statistics record (A6) and its saved baseline.
STATS = _s(("num_users", T.LongType(), False), ("num_movies", T.LongType(), False),
           ("num_ratings", T.LongType(), False), ("avg_rating", T.DoubleType(), False),
           ("std_rating", T.DoubleType(), False), ("min_rating", T.DoubleType(), False),
           ("max_rating", T.DoubleType(), False), ("num_days", T.LongType(), False))
BASELINE_STATS = T.StructType(STATS.fields + [T.StructField("timestamp", T.StringType(), True)])

# Runs table (experiment history).
RUNS = _s(("run_id", T.StringType(), False), ("run_name", T.StringType(), True),
          ("kind", T.StringType(), False), ("start_time", T.TimestampType(), False),
          ("params", T.MapType(T.StringType(), T.StringType()), True),
          ("metrics", T.MapType(T.StringType(), T.DoubleType()), True))

# Request events (streams S1-S5).
REQUEST_EVENTS = _s(("event_id", T.LongType(), True), ("ts", T.TimestampType(), True),
                    ("user_id", T.LongType(), True), ("event_type", T.StringType(), True),
                    ("value", T.DoubleType(), True), ("props", T.StringType(), True))
