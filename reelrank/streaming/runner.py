"""Running a streaming plan to completion into a table in the shared
checkpoint folder (sources, sinks and checkpoints all live there, so a
restarted driver resumes from the checkpoint)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from reelrank.session import scratch_path


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None):
    """Number of state-store partitions of the queries started inside.

    Stateful operators keep `spark.sql.shuffle.partitions` partitions for the
    life of the checkpoint (fixed at the first start). Sized here to about
    two per core of the session; the session's own setting is restored
    after the start.
    """
    n = n or max(2, 2 * spark.sparkContext.defaultParallelism)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def stage_events(events: DataFrame, name: str = "events-src") -> str:
    """Write request events as one folder per day: the stream's input files."""
    from pyspark.sql import functions as F
    path = scratch_path(events.sparkSession, name)
    events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.partitionBy("day").parquet(path)
    return path


def run_append(stream: DataFrame, name: str, spark: SparkSession) -> DataFrame:
    """Append-mode plan -> parquet file sink (exactly-once via its commit log)."""
    out, ck = scratch_path(spark, name), scratch_path(spark, name + "-ck")
    with state_partitions(spark):
        q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
             .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def run_complete(stream: DataFrame, name: str, spark: SparkSession, mode: str = "complete") -> DataFrame:
    """Complete/update-mode plan -> foreachBatch overwrite of a parquet table."""
    out, ck = scratch_path(spark, name), scratch_path(spark, name + "-ck")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    with state_partitions(spark):
        q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", ck)
             .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


def run_foreach(stream: DataFrame, fn, name: str, spark: SparkSession, checkpoint: str | None = None) -> None:
    """Everything that has arrived, through `fn(batch, batch_id)`; a given checkpoint continues an earlier run."""
    ck = checkpoint or scratch_path(spark, name + "-ck")
    with state_partitions(spark):
        q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
