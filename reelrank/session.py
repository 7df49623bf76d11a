"""Session helpers: a tuned local session for tests/bench and a shared scratch area.

On a cluster the session is created by the platform; the library only reads
`spark.checkpoint.dir` from it and never picks a machine-local folder there.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Conf applied to sessions this library builds (tests, bench). On a cluster the
# same keys belong in the job submission; AQE re-plans joins and coalesces
# shuffle partitions at runtime, skew join splits hot partitions.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "reelrank") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
    builder = builder.config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    Only a local session that names none (tests) gets a private folder; on any other master executors would write to
    their own disks, so an unset folder is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="reelrank-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder; it is removed when the application ends."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/reelrank/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


# Spark deletes the shuffle files of a query when it ends; otherwise they stay until the driver's JVM collects its plan.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_shuffles_left(spark: SparkSession):
    """What is written inside leaves no shuffle files behind: nothing reads them again once the table stands."""
    old = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, old)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh table in the shared checkpoint folder and read it back: computed once, lineage cut, safe against
    lost executors. The table goes when the application ends, or by `discard`."""
    path = scratch_path(df.sparkSession, name)
    with no_shuffles_left(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables whose every result is stored itself: nothing may read them again, lost executors included."""
    for df in tables:
        p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


DETACH_SECONDS = 1.5  # py4j tells the JVM once a second which objects Python has dropped
LISTEN_SECONDS = 0.5  # Spark's listeners hold the last query until they hear of something else, like the first blocks dropped


def drop_unreferenced(spark: SparkSession) -> None:
    """Have Spark drop the shuffles, cached blocks and broadcasts of RDDs that are out of reach. It learns of them when the
    driver's JVM collects them, which may be hours after the RDDs of a library (ALS) have filled disks and executors."""
    gc.collect()
    for seconds in (DETACH_SECONDS, LISTEN_SECONDS):
        time.sleep(seconds)
        spark.sparkContext._jvm.System.gc()


def require_utc(spark: SparkSession) -> None:
    """Day bucketing (P11) and ISO parsing are defined in UTC."""
    tz = spark.conf.get("spark.sql.session.timeZone")
    if tz not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem API (any cluster file system)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per application)."""
    import io
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="reelrank-code-"), "reelrank-code.zip")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("reelrank", os.path.relpath(full, root)))
    with open(path, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
