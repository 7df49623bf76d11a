"""Structured Streaming plans over request events and the recommendation log
(S1-S8). Each function takes a DataFrame and returns a DataFrame, so the
same plan runs on a stream (`readStream`) and on a batch table; tests check
stream == batch.

Request events: `event_type` is the endpoint label, `value` the duration in
milliseconds, `ts` the event time (zoned TIMESTAMP: watermarks reject NTZ).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelrank.functions.columns import default_method, mean_of_units, parse_iso_ts, rounded_mean, units
from reelrank.session import path_exists

# Default latency histogram bounds of the metrics client
# library (seconds), and the request label rules.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
GET_EVENTS = ["view", "click"]
ERROR_EVENT = "error"
WINDOW, SLIDE, WATERMARK = "5 minutes", "1 minute", "10 minutes"


def bucket_name(bound: float) -> str:
    return "le_" + repr(bound).replace(".", "_")


def request_labels(events: DataFrame) -> DataFrame:
    """method / endpoint / status labels and duration in seconds."""
    return events.select(
        "ts",
        F.when(F.col("event_type").isin(GET_EVENTS), "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("endpoint"),
        F.when(F.col("event_type") == ERROR_EVENT, "500").otherwise("200").alias("status"),
        (F.col("value") / 1000).alias("duration"))


def request_counter(events: DataFrame) -> DataFrame:
    """Requests per (method, endpoint, status); complete/update mode."""
    return request_labels(events).groupBy("method", "endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


def _bucket_aggs():
    aggs = [F.count(F.when(F.col("duration") <= b, 1)).alias(bucket_name(b)) for b in LATENCY_BOUNDS]
    return aggs + [F.count(F.lit(1)).alias("le_inf"), F.sum("duration").alias("duration_sum")]


def latency_histogram(events: DataFrame) -> DataFrame:
    """Cumulative latency buckets per (method, endpoint)."""
    return request_labels(events).groupBy("method", "endpoint").agg(*_bucket_aggs())


def request_rate(events: DataFrame, window: str = WINDOW, slide: str = SLIDE,
                 watermark: str = WATERMARK) -> DataFrame:
    """S3: per-second request rate over a sliding window, by endpoint (append mode)."""
    seconds = int(window.split()[0]) * 60
    lab = request_labels(events).withWatermark("ts", watermark)
    agg = lab.groupBy(F.window("ts", window, slide), "endpoint").agg(F.count(F.lit(1)).alias("requests"))
    return agg.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "endpoint",
                      "requests", (F.col("requests") / seconds).alias("rate"))


def histogram_quantile(q: float, cum: str = "buckets", total: str = "le_inf",
                       bounds_list: list[float] = LATENCY_BOUNDS) -> F.Column:
    """PromQL-style quantile from cumulative bucket counts (array column in
    bound order): linear interpolation inside the bucket; a quantile in the
    +Inf bucket returns the highest finite bound."""
    bounds = F.array(*[F.lit(float(b)) for b in bounds_list])
    n = len(bounds_list)
    rank = F.lit(q) * F.col(total)
    idx = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col(cum)[i] >= rank))
    lower = F.when(idx == 0, F.lit(0.0)).otherwise(bounds[idx - 1])
    below = F.when(idx == 0, F.lit(0)).otherwise(F.col(cum)[idx - 1])
    inside = F.col(cum)[idx] - below
    interp = lower + (bounds[idx] - lower) * F.when(inside > 0, (rank - below) / inside).otherwise(F.lit(1.0))
    return (F.when(F.col(total) == 0, F.lit(None).cast("double"))
            .when(idx.isNull(), F.lit(float(bounds_list[-1]))).otherwise(interp))


def latency_quantiles(events: DataFrame, window: str = WINDOW, watermark: str = WATERMARK) -> DataFrame:
    """p50 and p95 per tumbling window and endpoint (append mode). The
    buckets stay one array column, so the interpolation is a projection
    after the (only) stateful aggregate."""
    lab = request_labels(events).withWatermark("ts", watermark)
    agg = lab.groupBy(F.window("ts", window), "endpoint").agg(*_bucket_aggs())
    arr = F.array(*[F.col(bucket_name(b)) for b in LATENCY_BOUNDS])
    out = agg.withColumn("buckets", arr)
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "endpoint",
                      "le_inf", F.round(histogram_quantile(0.5), 6).alias("p50"),
                      F.round(histogram_quantile(0.95), 6).alias("p95"))


def gauges(events: DataFrame) -> DataFrame:
    """Last value (by event time) and running total per metric name."""
    return events.groupBy(F.col("event_type").alias("metric")).agg(
        F.max_by("value", "ts").alias("last_value"), F.round(F.sum("value"), 6).alias("total"),
        F.count(F.lit(1)).alias("updates"))


def reco_log_daily(log: DataFrame, popular_titles: F.Column, watermark: str = "1 hour") -> DataFrame:
    """Per day and method, list count, mean diversity/novelty of the lists
    and mean over all scores (append mode on the parsed log time)."""
    titles = F.transform("recommendations", lambda r: r["movie"])
    scores = F.transform("recommendations", lambda r: r["score"])
    n = F.size("recommendations")
    per = (log.withColumn("ts", parse_iso_ts("timestamp")).filter(F.col("ts").isNotNull())
           .select("ts", default_method("method").alias("method"),
                   F.when(n > 0, F.round(F.size(F.array_distinct(titles)) / n, 4)).otherwise(0.0).alias("diversity"),
                   F.when(n > 0, F.round(F.size(F.filter(titles, lambda t: ~F.array_contains(popular_titles, t))) / n,
                                         4)).otherwise(0.0).alias("novelty"),
                   F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.coalesce(s, F.lit(0.0))).alias("score_total"),
                   n.alias("k")))
    agg = (per.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), "method")
           .agg(F.count(F.lit(1)).alias("lists"), F.sum(units("diversity")).alias("d"),
                F.sum(units("novelty")).alias("v"), F.sum("score_total").alias("s"), F.sum("k").alias("k")))
    return agg.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "method", "lists",
                      mean_of_units("d", "lists").alias("avg_diversity"),
                      mean_of_units("v", "lists").alias("avg_novelty"),
                      rounded_mean("s", "k").alias("avg_score"))


def ingest_dedup(batches: DataFrame, keys: list[str], watermark: str = "30 days",
                 event_col: str = "event_time") -> DataFrame:
    """First arrival per key within the watermark (state kept only while
    a duplicate can still arrive)."""
    return batches.withWatermark(event_col, watermark).dropDuplicatesWithinWatermark(keys)


def merge_new_keys(target_path: str, keys: list[str], order: list[str], buckets: int = 256):
    """foreachBatch sink of S7: append the batch rows whose key is not stored, one row per key (the first by `order`).

    The target is partitioned by a hash of the key, so a batch reads the keys of the buckets that it touches and no
    others. Old rows are never rewritten, and a replayed batch finds its own keys and adds nothing.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        rest = [c for c in batch.columns if c not in keys]
        first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")
        fresh = first.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        try:
            if path_exists(spark, target_path):
                touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most `buckets` numbers
                stored = spark.read.parquet(target_path).filter(F.col("bucket").isin(touched)).select("bucket", *keys)
                new = fresh.join(stored, ["bucket", *keys], "left_anti")
            else:
                new = fresh
            new.select(*keys, *rest, "bucket").repartition("bucket").write.mode("append").partitionBy("bucket").parquet(target_path)
        finally:
            fresh.unpersist()
    return run


def replace_batch(target_path: str, rows):
    """foreachBatch sink of S8: `rows(batch)` becomes the table's part of this batch id, replacing what an earlier attempt of
    the batch wrote. The part is written aside and moved into place by one rename, so a reader sees the old or the new."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        part, aside = f"{target_path}/batch_id={batch_id}", f"{target_path}/_new/{batch_id}-{uuid.uuid4().hex}"
        rows(batch).write.parquet(aside)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(target_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(path(part), True)
        fs.rename(path(aside), path(part))
    return run
