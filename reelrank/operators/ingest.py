"""Typed ingest and normalisation.

Each raw source is read once with an explicit schema; the input splits of the
file scan replace the reference's chunked reads. Surrogate ids of the small
name tables follow the sorted distinct names, so they are
reproducible (the reference's SERIAL ids depend on insertion order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelrank.functions.columns import RATING_MAX, RATING_MIN, extract_year, normalise_epoch, split_genres
from reelrank.sources.schemas import RENAMES
from reelrank.operators.joins import spread_join
from reelrank.operators.prefix import numbered


def rename_columns(df: DataFrame, table: str) -> DataFrame:
    """camelCase source columns -> snake_case table columns."""
    return df.withColumnsRenamed(RENAMES[table])


def project_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """P2."""
    return df.select(*columns)


def normalise_items(raw_items: DataFrame) -> DataFrame:
    """items table: item_id, title, release_year."""
    return (rename_columns(raw_items, "items")
            .select("item_id", "title", extract_year("title").alias("release_year")))


def explode_genres(raw_items: DataFrame) -> DataFrame:
    """One row per (item, genre name); '(no genres listed)' stays a genre."""
    return raw_items.select(F.col("movieId").alias("item_id"),
                            F.explode(split_genres("genres")).alias("genre"))


def distinct_genres(raw_items: DataFrame) -> DataFrame:
    """A19."""
    return explode_genres(raw_items).select(F.col("genre").alias("name")).distinct()


def dense_ids(names: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """1-based consecutive ids in sorted order of the distinct `name_col` values (= dense_rank over the sorted names),
    reproducible run to run: range partitions numbered from the row counts of the earlier ones."""
    return numbered(names.select(name_col).distinct(), [name_col], id_col).select(id_col, name_col)


def genres_from_items(raw_items: DataFrame) -> DataFrame:
    """genres table with reproducible ids."""
    return dense_ids(distinct_genres(raw_items), "name", "genre_id")


def item_genres_from_items(raw_items: DataFrame, genres: DataFrame) -> DataFrame:
    """(item, genre name) joined to the genre table on name; a frequent name is spread over several tasks."""
    pairs = explode_genres(raw_items)
    return (spread_join(pairs, genres.withColumnRenamed("name", "genre"), "genre")
            .select("item_id", "genre_id").distinct())


def drop_null_tags(raw_tags: DataFrame) -> DataFrame:
    """Only real NULLs are missing (literal 'NA' text stays a tag)."""
    return raw_tags.filter(F.col("tag").isNotNull())


def distinct_tags(raw_tags: DataFrame) -> DataFrame:
    """Distinct non-null tags over all input splits."""
    return drop_null_tags(raw_tags).select("tag").distinct()


def tags_from_raw(raw_tags: DataFrame) -> DataFrame:
    """tags table with reproducible ids."""
    return dense_ids(distinct_tags(raw_tags), "tag", "tag_id")


def filter_known_tags(raw_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Keep rows whose tag is in the tag table."""
    return raw_tags.join(tags.select("tag"), "tag", "left_semi")


def item_tags_from_raw(raw_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Tag -> tag_id lookup, one row per key (latest timestamp kept)."""
    t = rename_columns(raw_tags, "tags")
    joined = t.join(tags, "tag")  # inner join = P7 filter + id lookup in one step
    return (joined.groupBy("user_id", "item_id", "tag_id")
            .agg(F.max("timestamp").alias("timestamp")))


def normalise_ratings(raw_ratings: DataFrame) -> DataFrame:
    """ratings table: renames, epoch normalisation (P12), DECIMAL(2,1) rating."""
    return (rename_columns(raw_ratings, "ratings")
            .select("user_id", "item_id", F.col("rating").cast("decimal(2,1)").alias("rating"),
                    normalise_epoch("timestamp").alias("timestamp")))


def distinct_users(ratings: DataFrame) -> DataFrame:
    """Users derived from ratings (one shuffle, partial distinct per split)."""
    return ratings.select("user_id").distinct()


def rating_domain_check(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """P18 + J13: every row with a rejection reason (NULL reason = valid).

    Domain checks are plain predicates; the foreign-key checks are two
    left-anti probes expressed as left joins against the key sets, so the
    ratings table is scanned once.
    """
    u = users.select("user_id").distinct().withColumn("_u", F.lit(True))
    i = items.select("item_id").distinct().withColumn("_i", F.lit(True))
    r = ratings.join(u, "user_id", "left").join(i, "item_id", "left")
    rating = F.col("rating")
    reason = (F.when(rating.isNull(), "rating_null")
              .when((rating < RATING_MIN) | (rating > RATING_MAX), "rating_out_of_range")
              .when(F.col("_u").isNull(), "unknown_user")
              .when(F.col("_i").isNull(), "unknown_item"))
    return r.select("user_id", "item_id", "rating", "timestamp", reason.alias("reason"))


def split_valid_rejected(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def referential_check(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is missing in the parent."""
    return child.join(parent.select(key), key, "left_anti")


def append_new_rows(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """append_table key rule: rows of the batch to append.

    The batch is de-duplicated on the key (one row per key: the first by the
    remaining columns, so the choice is deterministic) and rows whose key is
    already in the target are removed with a left-anti join. Where the
    reference raises on a key clash, this returns the clash-free rows.
    """
    others = [c for c in batch.columns if c not in keys]
    if others:
        first = F.min(F.struct(*[F.col(c) for c in others])).alias("_r")
        dedup = batch.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])
    else:
        dedup = batch.select(*keys).distinct()
    return dedup.join(target.select(*keys), keys, "left_anti")
