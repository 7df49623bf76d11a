"""Sinks: append key rule, load-if-empty, per-user CSV layouts, baseline round trips."""

from pyspark.sql import functions as F

from reelrank.operators import ingest as I
from reelrank.sinks import writers as W

SCHEMA = "user_id bigint, item_id bigint, rating double, timestamp bigint"


def test_append_table_key_rule(spark, tmp_path):
    target = str(tmp_path / "ratings")
    first = spark.createDataFrame([(1, 10, 4.0, 1), (1, 11, 3.0, 2)], SCHEMA)
    assert W.append_table(first, target, ["user_id", "item_id"], spark).count() == 2
    batch = spark.createDataFrame([(1, 10, 5.0, 9), (2, 10, 2.0, 3), (2, 10, 1.0, 4), (3, 12, 3.5, 5)], SCHEMA)
    new_rows = I.append_new_rows(batch, spark.read.parquet(target), ["user_id", "item_id"]).collect()
    assert sorted((r.user_id, r.item_id, r.rating) for r in new_rows) == [(2, 10, 1.0), (3, 12, 3.5)]
    W.append_table(batch, target, ["user_id", "item_id"], spark)
    stored = spark.read.parquet(target)
    assert stored.count() == 4
    assert stored.groupBy("user_id", "item_id").count().filter("count > 1").count() == 0


def test_load_if_empty(spark, tmp_path):
    target = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 10, 4.0, 1)], SCHEMA)
    calls = []

    def loader(p):
        calls.append(p)
        df.write.mode("append").parquet(p)

    assert W.load_if_empty(target, loader, spark) is True
    assert W.load_if_empty(target, loader, spark) is False
    assert len(calls) == 1 and spark.read.parquet(target).count() == 1


def _lists(spark, users):
    rows = [(u, r, f"m{u}-{r}", 5.0 - r / 10) for u in range(users) for r in range(1, 4)]
    return spark.createDataFrame(rows, "user_id bigint, rank int, movie string, score double")


def test_write_topn_csv_one_layout(spark, tmp_path):
    for users in (3, 12):
        path = str(tmp_path / str(users))
        W.write_topn_csv(_lists(spark, users), path)
        back = W.read_topn_csv(spark, path)
        assert back.columns == ["user_id", "rank", "movie", "score"]
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, _lists(spark, users).collect()))


def test_cluster_without_shared_folder_is_refused():
    import pytest

    from reelrank.session import ensure_checkpoint_dir

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            raise AssertionError("nothing may be set")

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_baseline_round_trip(spark, tmp_path, f1):
    from reelrank.operators import analytics as A
    path = str(tmp_path / "b")
    assert W.load_baseline_stats(spark, path) is None
    W.save_baseline_stats(A.data_statistics(f1), path, "2024-01-01T00:00:00")
    got = W.load_baseline_stats(spark, path).first()
    assert got.num_ratings == 6 and got.timestamp == "2024-01-01T00:00:00"
    assert W.load_baseline_rows(spark, str(tmp_path / "none")) is None
