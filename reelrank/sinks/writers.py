"""Sinks: appends, overwrites and per-user outputs.

All writes are DataFrame writers (one task per partition, committed by the
output committer), so a lost executor only re-runs its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelrank.operators.ingest import append_new_rows
from reelrank.session import path_exists


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV with double-quote quoting and escaping (as the raw sources)."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """scan_*_csv: typed CSV scan, never inferred."""
    return (spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").csv(path))


def append_table(batch: DataFrame, target_path: str, keys: list[str], spark: SparkSession) -> DataFrame:
    """append_table: append the clash-free rows of `batch` to the parquet table
    at `target_path` (created when absent); returns the appended rows."""
    if path_exists(spark, target_path):
        target = spark.read.parquet(target_path)
    else:
        target = spark.createDataFrame([], batch.schema)
    new_rows = append_new_rows(batch, target, keys)
    new_rows.write.mode("append").parquet(target_path)
    return new_rows


def load_if_empty(target_path: str, loader, spark: SparkSession) -> bool:
    """load_if_empty: run `loader(path)` only when the target has no rows.

    Returns True when a load ran. The check reads at most one row.
    """
    empty = not path_exists(spark, target_path) or spark.read.parquet(target_path).isEmpty()
    if empty:
        loader(target_path)
    return empty


def write_topn_csv(lists: DataFrame, path: str) -> None:
    """write_topn_csv: top-N lists as one CSV dataset (user_id, rank, movie, score).

    One layout whatever the number of users: a file or folder per user would mean millions of tiny files. Each user's
    rows stand in one file, in rank order.
    """
    (lists.select("user_id", "rank", "movie", "score").repartition("user_id").sortWithinPartitions("user_id", "rank")
     .write.mode("overwrite").option("header", True).csv(path))


def read_topn_csv(spark: SparkSession, path: str) -> DataFrame:
    """The lists of write_topn_csv."""
    return spark.read.option("header", True).schema("user_id bigint, rank int, movie string, score double").csv(path)


def write_predict_metrics(top_scores: DataFrame, path: str) -> None:
    """write_predict_metrics: `user_<id>_top_score` records as JSON lines."""
    (top_scores.select(F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit("_top_score")).alias("metric"),
                       F.col("top_score").alias("value"))
     .write.mode("overwrite").json(path))


def save_baseline_stats(stats: DataFrame, path: str, as_of_iso: str | None = None) -> DataFrame:
    """save_baseline_stats: statistics record + ISO time, overwrite."""
    ts = F.lit(as_of_iso) if as_of_iso else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    out = stats.withColumn("timestamp", ts)
    out.coalesce(1).write.mode("overwrite").json(path)
    return out


def load_baseline_stats(spark: SparkSession, path: str):
    """load_baseline_stats: the saved record, or None when absent."""
    from reelrank.sources.schemas import BASELINE_STATS
    if not path_exists(spark, path):
        return None
    df = spark.read.schema(BASELINE_STATS).json(path)
    return None if df.isEmpty() else df


def save_snapshots(rows: DataFrame, path: str) -> None:
    """Versioned baselines: rows with `dataset` and `as_of` (epoch seconds), one version per value of `as_of`. A version that
    is saved again replaces itself; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "as_of").parquet(path)


def load_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All versions; a reader takes the latest one before its time (`drift.as_of`)."""
    return spark.read.parquet(path).withColumn("as_of", F.col("as_of").cast("bigint"))


def save_baseline_rows(rows: DataFrame, path: str) -> None:
    """save_baseline_rows: the (already capped) sample, overwrite."""
    rows.write.mode("overwrite").parquet(path)


def load_baseline_rows(spark: SparkSession, path: str):
    """load_baseline_rows: stored rows, or None when the folder is absent (other read errors are raised)."""
    if not path_exists(spark, path):
        return None
    return spark.read.parquet(path)


def write_drift_report(rows: DataFrame, path: str) -> None:
    """write_drift_report: drift rows as JSON."""
    rows.coalesce(1).write.mode("overwrite").json(path)
