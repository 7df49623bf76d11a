"""Equi-joins whose hot keys are split over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that stay together on the left side of a salted join.
ROWS_PER_SALT = 1_000_000
# Parts of every key in a spread join.
SPREAD = 16


def salted_join(left: DataFrame, right: DataFrame, key: str, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Inner join on `key`. A key with more than `rows_per_salt` rows on the left is dealt into parts of that size, and its
    right rows are repeated for each part, so one key never fills one task. At most one key per `rows_per_salt` left rows
    is hot, which bounds the broadcast list of them."""
    heavy = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_salt)
    heavy = F.broadcast(heavy.select(key, F.ceil(F.col("_n") / rows_per_salt).cast("int").alias("_parts")))
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = left.join(heavy, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("_parts")
    copies = right.join(heavy, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def spread_join(left: DataFrame, right: DataFrame, key: str, parts: int = SPREAD) -> DataFrame:
    """Inner join of a long left side with a short right one: every key is dealt into `parts`, the right rows are repeated
    for each. Nothing is counted beforehand; the runtime broadcasts the right side when its bytes allow it."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(parts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies, [key, "_salt"]).drop("_salt")
