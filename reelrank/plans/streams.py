"""Registered streaming queries (S1-S8). Inputs are staged as files in the
shared checkpoint folder (events by day, log lines, line-level ratings by
day) and read with `readStream`; each query runs with an `availableNow`
trigger and returns the table its sink wrote. The SQL oracles compute the
same result in one batch; append-mode windows are emitted once the
watermark (max event time - delay) passes their end, which the oracles
state explicitly.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reelrank.functions.columns import ntz_to_epoch
from reelrank.operators import analytics as A
from reelrank.operators import drift as D
from reelrank.operators import quality as Q
from reelrank.plans.catalog import POPULAR_MIN, RECENT_DAYS, _POPULAR_TITLES_SQL, register
from reelrank.session import scratch_path, stored
from reelrank.sources.schemas import RECO_LOG_WITH_CORRUPT
from reelrank.streaming import metrics as S
from reelrank.streaming.runner import run_append, run_complete, run_foreach, stage_events


def _event_stream(m):
    spark = m.spark
    path = stage_events(m.events())
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)


_LABELS = """
, lab AS (SELECT ts, CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method,
                 '/' || event_type AS endpoint, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
                 value / 1000 AS duration FROM events)
"""


def _bucket_sql():
    cols = [f"count(*) FILTER (WHERE duration <= {b!r}) AS {S.bucket_name(b)}" for b in S.LATENCY_BOUNDS]
    return ", ".join(cols) + ", count(*) AS le_inf"


@register("request_counter", _LABELS + "SELECT method, endpoint, status, count(*) AS requests FROM lab GROUP BY 1, 2, 3")
def request_counter(m):
    return run_complete(S.request_counter(_event_stream(m)), "s1", m.spark)


@register("latency_histogram", _LABELS + f"""
SELECT method, endpoint, {_bucket_sql()}, round(sum(duration), 6) AS duration_sum FROM lab GROUP BY 1, 2""")
def latency_histogram(m):
    out = run_complete(S.latency_histogram(_event_stream(m)), "s2", m.spark)
    return out.withColumn("duration_sum", F.round("duration_sum", 6))


_RATE_SQL = _LABELS + """
, w AS (SELECT date_trunc('minute', ts) - to_minutes(k) AS ws, endpoint FROM lab, (SELECT unnest(range(0, 5)) AS k) r)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, count(*) AS requests, count(*) / 300 AS rate
FROM w GROUP BY ws, endpoint
HAVING ws + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


@register("rate_5m", _RATE_SQL)
def rate_5m(m):
    """S3: per-second request rate over 5-minute windows sliding by 1 minute."""
    return run_append(S.request_rate(_event_stream(m)), "s3", m.spark)


def _quantile_sql(q: float, name: str) -> str:
    i = f"i_{name}"
    prev_c = f"(CASE WHEN {i} = 1 THEN 0 ELSE cum[{i} - 1] END)"
    prev_b = f"(CASE WHEN {i} = 1 THEN 0.0 ELSE bnd[{i} - 1] END)"
    inside = f"(cum[{i}] - {prev_c})"
    interp = (f"{prev_b} + (bnd[{i}] - {prev_b}) * "
              f"(CASE WHEN {inside} > 0 THEN ({q!r} * le_inf - {prev_c}) / {inside} ELSE 1.0 END)")
    return (f"round(CASE WHEN le_inf = 0 THEN NULL WHEN {i} IS NULL THEN {S.LATENCY_BOUNDS[-1]!r} "
            f"ELSE {interp} END, 6) AS {name}")


_BND = "[" + ", ".join(repr(b) for b in S.LATENCY_BOUNDS) + "]"
_CUM = "[" + ", ".join(S.bucket_name(b) for b in S.LATENCY_BOUNDS) + "]"


_QUANTILE_SQL = _LABELS + f"""
, t AS (SELECT date_trunc('minute', ts) - to_minutes(minute(ts) % 5) AS ws, endpoint, duration FROM lab),
  agg AS (SELECT ws, endpoint, {_bucket_sql()} FROM t GROUP BY ws, endpoint
          HAVING ws + INTERVAL 5 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE),
  arr AS (SELECT ws, endpoint, le_inf, {_CUM} AS cum, {_BND} AS bnd FROM agg),
  b AS (SELECT ws, endpoint, le_inf, cum, bnd, unnest(range(1, {len(S.LATENCY_BOUNDS) + 1})) AS i, unnest(cum) AS c FROM arr),
  idx AS (SELECT ws, endpoint, le_inf, any_value(cum) AS cum, any_value(bnd) AS bnd,
                 min(i) FILTER (WHERE c >= 0.5 * le_inf) AS i_p50, min(i) FILTER (WHERE c >= 0.95 * le_inf) AS i_p95
          FROM b GROUP BY ws, endpoint, le_inf)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, endpoint, le_inf, {_quantile_sql(0.5, 'p50')},
       {_quantile_sql(0.95, 'p95')} FROM idx"""


@register("quantile_5m", _QUANTILE_SQL)
def quantile_5m(m):
    """p50/p95 latency per 5-minute window from histogram buckets."""
    return run_append(S.latency_quantiles(_event_stream(m)), "s4", m.spark)


@register("gauges", """
SELECT event_type AS metric, arg_max(value, ts) AS last_value, round(sum(value), 6) AS total, count(*) AS updates
FROM events GROUP BY 1""")
def gauges(m):
    return run_complete(S.gauges(_event_stream(m)), "s5", m.spark)


@register("reco_log_stream", _POPULAR_TITLES_SQL + """
SELECT strftime(d, '%Y-%m-%d') AS day, method, count(*) AS lists,
       ((2 * sum(CAST(round(diversity * 10000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000.0 AS avg_diversity,
       ((2 * sum(CAST(round(novelty * 10000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000.0 AS avg_novelty,
       CASE WHEN sum(list_size) > 0 THEN round(sum(score_total) / sum(list_size), 4) ELSE 0.0 END AS avg_score
FROM (SELECT CAST(ts AS DATE) AS d, coalesce(method, 'unknown') AS method, diversity, novelty, list_size, score_total
      FROM metrics) x
GROUP BY d, method
HAVING CAST(d AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM reco_log) - INTERVAL 1 HOUR""")
def reco_log_stream(m):
    spark = m.spark
    path = scratch_path(spark, "reco-log-src")
    Q.append_reco_log(Q.log_entries_from_events(m.events(), m.items()), path)
    raw = spark.readStream.schema(RECO_LOG_WITH_CORRUPT).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    log = raw.filter(F.col("_corrupt_record").isNull() & F.col("recommendations").isNotNull()
                     & F.col("timestamp").isNotNull())
    # a streaming plan takes the top-100 report as a literal (bounded by its limit)
    pop = F.array(*[F.lit(r.title) for r in Q.popular_titles(m.ratings(), m.items(), POPULAR_MIN, 100).collect()]).cast("array<string>")
    return run_append(S.reco_log_daily(log, pop), "s6", spark)


def _line_ratings(m):
    li = m.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_suppkey")
    o = m.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"),
                    (F.least(F.lit(10.0), F.ceil(F.col("l_quantity") / 5)) * 0.5).alias("rating"),
                    ntz_to_epoch("o_orderdate").alias("timestamp"),
                    F.col("o_orderdate").cast("timestamp").alias("event_time"),
                    "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", F.year("o_orderdate").alias("year")))


def _run_by_year(m, name, sink, prepare=lambda stream: stream):
    """Streams the rating lines year by year into the sink: the files of a year arrive, the query runs until they are
    consumed and continues from its checkpoint with the next year. So every micro-batch with data is one year."""
    spark = m.spark
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-ck")
    source = _line_ratings(m)
    by_year = scratch_path(spark, f"{name}-lines")
    source.write.partitionBy("year").parquet(by_year)  # a year is read from its own folder, not filtered out of all lines
    lines = spark.read.schema(source.schema).parquet(by_year).select(source.columns)
    for r in lines.select("year").distinct().orderBy("year").collect():  # one row per year
        lines.filter(F.col("year") == r.year).write.mode("append").parquet(path)
        run_foreach(prepare(spark.readStream.schema(lines.schema).parquet(path)), sink, name, spark, checkpoint)


@register("ratings_ingest_stream", """
, l AS (SELECT *, CAST(least(10, ceil(l_quantity / 5)) * 0.5 AS DOUBLE) AS rating FROM li_o)
SELECT user_id, item_id, rating, "timestamp" FROM (SELECT user_id, item_id, rating, ts AS "timestamp", row_number() OVER (PARTITION BY user_id, item_id
  ORDER BY ts, l_orderkey, l_linenumber, l_suppkey, l_quantity) AS rn FROM l) s WHERE rn = 1""")
def ratings_ingest_stream(m):
    """Yearly rating files merged into the ratings table: the first rating of each (user, item) in arrival order stays,
    with its value and time; keys already stored are found in the touched buckets only."""
    spark = m.spark
    target = scratch_path(spark, "s7-target")
    order = ["timestamp", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]
    _run_by_year(m, "s7-src", S.merge_new_keys(target, ["user_id", "item_id"], order, 16), lambda stream: stream.drop("year", "event_time"))
    return spark.read.parquet(target).select("user_id", "item_id", "rating", "timestamp")


@register("ratings_ingest_dedup", "SELECT DISTINCT user_id, item_id FROM li_o")
def ratings_ingest_dedup(m):
    """S7 with watermarked de-duplication before the merge: the keys of all rating lines."""
    spark = m.spark
    target = scratch_path(spark, "s7d-target")
    _run_by_year(m, "s7d-src", S.merge_new_keys(target, ["user_id", "item_id"], ["timestamp", "l_orderkey"], 16),
                 lambda stream: S.ingest_dedup(stream, ["user_id", "item_id"]).drop("year"))
    return spark.read.parquet(target).select("user_id", "item_id")


@register("drift_stream", f"""
, l AS (SELECT *, CAST(least(10, ceil(l_quantity / 5)) * 0.5 AS DOUBLE) AS rating, year(to_timestamp(ts)) AS y FROM li_o),
  b AS (SELECT y, dense_rank() OVER (ORDER BY y) - 1 AS batch_id FROM (SELECT DISTINCT y FROM l) s),
  cur AS (SELECT batch_id, CAST(count(DISTINCT user_id) AS DOUBLE) AS num_users, CAST(count(DISTINCT item_id) AS DOUBLE) AS num_movies,
                 CAST(count(*) AS DOUBLE) AS num_ratings, avg(rating) AS avg_rating FROM l JOIN b USING (y) GROUP BY batch_id),
  base AS (SELECT CAST(count(DISTINCT user_id) AS DOUBLE) AS num_users, CAST(count(DISTINCT item_id) AS DOUBLE) AS num_movies,
                  CAST(count(*) AS DOUBLE) AS num_ratings, coalesce(avg(rating), 0.0) AS avg_rating FROM ratings
           WHERE "timestamp" < (SELECT max("timestamp") FROM ratings) - {RECENT_DAYS} * 86400),
  lc AS (UNPIVOT cur ON avg_rating, num_users, num_movies, num_ratings INTO NAME metric VALUE current),
  lb AS (UNPIVOT base ON avg_rating, num_users, num_movies, num_ratings INTO NAME metric VALUE baseline)
SELECT CAST(batch_id AS INTEGER) AS batch_id, metric, round(baseline, 9) AS baseline, round(current, 9) AS current, round(abs((current - baseline) / baseline * 100), 2) AS change_pct,
       CASE WHEN abs((current - baseline) / baseline * 100) > 10.0 THEN 'drift_detected' ELSE 'normal' END AS status
FROM lc JOIN lb USING (metric) WHERE baseline <> 0""")
def drift_stream(m):
    """Every micro-batch (a year of rating lines) is compared with a fixed baseline (statistics of ratings older than one
    year); drift rows per batch, replaced as a whole when a batch runs again."""
    spark = m.spark
    r = m.ratings()
    max_ts = r.select(F.max("timestamp")).scalar()
    baseline = stored(A.data_statistics(r.filter(F.col("timestamp") < max_ts - RECENT_DAYS * 86400)), "s8-baseline")
    out = scratch_path(spark, "s8-out")
    _run_by_year(m, "s8-src", S.replace_batch(out, lambda batch: D.detect_drift(A.data_statistics(batch), baseline)))
    got = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    return got.select(F.col("batch_id").cast("int").alias("batch_id"), "metric", F.round("baseline", 9).alias("baseline"), F.round("current", 9).alias("current"),
                      "change_pct", "status")
