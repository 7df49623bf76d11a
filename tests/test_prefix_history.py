"""Prefix sums, salted joins, versioned snapshots, run history and the two batch sinks."""

import pytest
from pyspark.sql import functions as F

from reelrank.operators import drift as D
from reelrank.operators import joins as J
from reelrank.operators import prefix as P
from reelrank.operators import runs as RU
from reelrank.sinks import writers as W
from reelrank.streaming import metrics as S


def test_numbers_follow_the_order_at_millions_of_values(spark):
    n = 2_000_000
    df = spark.range(n).select(((F.col("id") * 7919) % n).alias("v"))
    got = P.numbered(df, ["v"], "at")
    assert got.filter(F.col("at") != F.col("v") + 1).count() == 0 and got.count() == n
    assert "SinglePartition" not in got._jdf.queryExecution().toString()


def test_running_sums_spread_one_column_over_tasks(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit("c").alias("column"), ((F.col("id") * 7919) % n).alias("value"), F.lit(1).alias("ca"))
    got = P.running_sums(df, ["column"], ["value"], ["ca"])
    assert got.filter(F.col("run_ca") != F.col("value") + 1).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "_part" in plan
    source = spark.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0])
    parts = [r.n for r in source.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(parts) > 1 and max(parts) < n / 2  # no task holds the column


def test_running_sums_by_group_against_a_window(spark):
    from pyspark.sql.window import Window
    df = spark.range(5000).select((F.col("id") % 7 % 3).alias("g"), F.col("id").alias("o"), (F.col("id") * 31 % 17).alias("x"))
    want = df.withColumn("run_x", F.sum("x").over(Window.partitionBy("g").orderBy("o")))
    assert sorted(map(tuple, P.running_sums(df, ["g"], ["o"], ["x"]).collect())) == sorted(map(tuple, want.collect()))


def test_joins_with_a_hot_key_equal_the_plain_join(spark):
    left = spark.range(600).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = spark.range(60).select((F.col("id") % 40).alias("k"), F.col("id").alias("b"))
    want = sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))
    for got in (J.salted_join(left, right, "k", 10), J.salted_join(left, right, "k"), J.spread_join(left, right, "k")):
        assert sorted(map(tuple, got.select("k", "a", "b").collect())) == want


STATS = "dataset string, period string, since long, as_of long, avg_rating double, num_users long, num_movies long, num_ratings long"


def test_checks_read_the_snapshot_as_of_their_time(spark, tmp_path):
    rows = [("r", "p1", 0, 9, 4.0, 10, 10, 100), ("r", "p2", 10, 19, 4.0, 10, 10, 105), ("r", "p3", 20, 29, 4.0, 10, 10, 300), ("other", "p1", 50, 60, 1.0, 0, 1, 1)]
    all_rows = spark.createDataFrame(rows, STATS)
    path = str(tmp_path / "snap")
    W.save_snapshots(all_rows.filter("dataset = 'r'").drop("period", "since"), path)
    W.save_snapshots(all_rows.filter("dataset = 'r' and as_of = 19").drop("period", "since"), path)  # saved again: replaces itself
    snaps = W.load_snapshots(spark, path)
    assert snaps.count() == 3
    got = {(r.dataset, r.period): r for r in D.baseline_checks(all_rows, snaps).collect()}
    assert (got["r", "p1"].status, got["r", "p1"].drift_detected, got["r", "p1"].metrics_checked) == ("baseline_created", False, 0)
    assert (got["r", "p2"].status, got["r", "p2"].baseline_version, got["r", "p2"].drift_detected) == ("compared", 9, False)
    assert (got["r", "p3"].baseline_version, got["r", "p3"].metrics_drifted) == (19, 1)
    assert got["other", "p1"].status == "baseline_created"


def test_schema_changes(spark):
    now = spark.createDataFrame([(1, "a", "1"), (1, "a", "2"), (1, "b", "1.5"), (1, "c", None), (2, "a", "x"), (2, "d", "-3e4")], "g int, name string, value string")
    seen = {(r.g, r.name): r.type for r in D.observed_schema(now, ["g"]).collect()}
    assert seen == {(1, "a"): "bigint", (1, "b"): "double", (2, "a"): "string", (2, "d"): "double"}
    base = spark.createDataFrame([(g, n, t) for g in (1, 2) for n, t in (("a", "bigint"), ("b", "double"))], "g int, name string, type string")
    got = {r.g: r for r in D.schema_changes(D.observed_schema(now, ["g"]), base, ["g"]).collect()}
    assert (got[1].added, got[1].missing, got[1].type_changed, got[1].drift_detected) == ("", "", "", False)
    assert (got[2].added, got[2].missing, got[2].type_changed, got[2].drift_detected) == ("d", "b", "a", True)


def test_drift_method_and_fallback(spark):
    rows = spark.createDataFrame([(u, i, float(1 + (u + i) % 5), u * 100 + i) for u in range(20) for i in range(10)], "user_id long, item_id long, rating double, timestamp long")
    assert [D.drift_with_fallback(rows, rows, x).first().method for x in ("ks", "stats")] == ["ks", "stats"]
    assert not D.drift_with_fallback(rows, rows, "ks").first().drift_detected
    assert D.drift_with_fallback(rows.limit(0), rows, "ks").first().method == "stats"
    with pytest.raises(ValueError):
        D.drift_with_fallback(rows, rows, "other")


def test_history_by_hand(spark, tmp_path):
    """Two periods: the second is judged with what the first taught."""
    rows = [(1, 10, 4.0, 1), (2, 10, 2.0, 2), (1, 11, 5.0, 3), (3, 10, 3.0, 101), (3, 12, 1.0, 102), (4, 10, 5.0, 103)]
    r = spark.createDataFrame(rows, "user_id long, item_id long, rating double, timestamp long")
    runs = RU.period_runs(r, F.floor(F.col("timestamp") / 100))
    path = str(tmp_path / "runs")
    for _ in range(2):
        RU.log_runs(runs, path)
    got = {x.run_name: x for x in RU.read_runs(spark, path).collect()}
    assert sorted(got) == ["Prediction_User_3_1", "train_1"]
    mu = 11 / 3
    est = {10: mu + (6 - 2 * mu) / 12, 12: mu}
    rmse = (((3 - est[10]) ** 2 + (1 - est[12]) ** 2 + (5 - est[10]) ** 2) / 3) ** 0.5
    assert got["train_1"].metrics["bias_rmse"] == pytest.approx(rmse)
    assert got["train_1"].params["is_best_model"] == "true"
    assert got["Prediction_User_3_1"].metrics["top_score"] == pytest.approx(max(est.values()))
    assert RU.latest_run(RU.read_runs(spark, path), "train").first().run_name == "train_1"


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "s8")
    sink = S.replace_batch(out, lambda batch: batch.selectExpr("id", "id * 2 AS twice"))
    read = lambda: sorted(map(tuple, spark.read.option("basePath", out).parquet(f"{out}/batch_id=*").collect()))
    sink(spark.range(3), 0)
    sink(spark.range(5), 1)
    before = read()
    sink(spark.range(5), 1)
    assert read() == before and len(before) == 8
    sink(spark.range(1), 1)
    assert len(read()) == 4


def test_merge_reads_touched_buckets_only(spark, tmp_path):
    target = str(tmp_path / "s7")
    sink = S.merge_new_keys(target, ["k"], ["t"], 8)
    rows = lambda *x: spark.createDataFrame(list(x), "k long, t long, v string")
    sink(rows((1, 5, "late"), (1, 3, "first"), (2, 1, "two")), 0)
    sink(rows((1, 1, "too late"), (3, 9, "three")), 1)
    sink(rows((1, 1, "too late"), (3, 9, "three")), 1)
    got = sorted((r.k, r.t, r.v) for r in spark.read.parquet(target).collect())
    assert got == [(1, 3, "first"), (2, 1, "two"), (3, 9, "three")]
    # a broken file in a bucket that a batch does not touch goes unread
    used = {r.bucket for r in spark.read.parquet(target).select("bucket").distinct().collect()}
    other = next(b for b in range(8) if b not in used)
    (tmp_path / "s7" / f"bucket={other}").mkdir()
    (tmp_path / "s7" / f"bucket={other}" / "part-0.parquet").write_bytes(b"broken")
    schema = "k long, t long, v string, bucket int"
    assert spark.read.schema(schema).parquet(target).filter(F.col("bucket").isin(*used)).count() == 3
