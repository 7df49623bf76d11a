"""What the factorisation leaves on disk and in the executors, and while it runs; what `best_of` compares."""

import os
import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from reelrank.operators import evaluate as E
from reelrank.operators import recommend as R
from reelrank.plans import learn
from reelrank.session import drop_unreferenced, ensure_checkpoint_dir, stored


def shuffle_files(spark) -> set:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for d in folders for _, _, names in os.walk(d.getPath()) for f in names if f.startswith("shuffle_")}


def cached_blocks(spark) -> int:
    return sum(i.numCachedPartitions() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo())


def tables(spark) -> set:
    folder = f"{ensure_checkpoint_dir(spark).removeprefix('file:').rstrip('/')}/reelrank"
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


def settled(what, wanted, seconds: int = 20):
    """The value of what(), read again while it is not wanted: Spark drops in the background."""
    end = time.time() + seconds
    while not wanted(got := what()) and time.time() < end:
        time.sleep(0.2)
    return got


def ratings_of(spark, users: int = 40, items: int = 25):
    rows = [(u, i, float(1 + (u * 7 + i * i) % 5)) for u in range(users) for i in range(items) if (u + i) % 3]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double").repartition(4)


def test_stored_tables_leave_no_shuffles(spark):
    drop_unreferenced(spark)
    before = settled(lambda: shuffle_files(spark), lambda x: not x, 3)
    df = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count()
    got = stored(df, "t-counts")
    assert not settled(lambda: shuffle_files(spark) - before, lambda x: not x, 5)
    assert sorted(r["count"] for r in got.collect()) == sorted(r["count"] for r in df.collect()) and got.count() == 7


def test_the_fit_leaves_only_its_model(spark, monkeypatch):
    """Ten iterations never lie on disk together, and after the fit no shuffle, cached block or working table is left."""
    ratings, at_return, fit = ratings_of(spark), [], R.ALS.fit

    def spy(self, data, *rest):
        old = shuffle_files(spark)
        model = fit(self, data, *rest)
        at_return.append(settled(lambda: len({f.split("_")[1] for f in shuffle_files(spark) - old}), lambda n: n <= 10))
        return model

    ratings.count()
    drop_unreferenced(spark)
    settled(lambda: shuffle_files(spark), lambda x: not x, 3)
    files, made, cached = shuffle_files(spark), tables(spark), cached_blocks(spark)
    monkeypatch.setattr(R.ALS, "fit", spy)
    model = R.fit_mf(ratings, rank=2, max_iter=10, seed=1)
    assert at_return[0] <= 10  # three for the blocks of the ratings, two for an iteration
    assert not settled(lambda: shuffle_files(spark) - files, lambda x: not x)
    assert settled(lambda: cached_blocks(spark), lambda n: n <= cached) <= cached
    assert not {t for t in tables(spark) - made if t.startswith(("train", "without-items", "residuals"))}
    assert model.user_factors.count() == 40 and model.item_factors.count() == 25


def test_a_fold_is_judged_before_the_next_fit(spark, monkeypatch):
    ratings, steps, before = ratings_of(spark), [], tables(spark)
    fit, keep = R.fit_mf, E.stored
    monkeypatch.setattr(R, "fit_mf", lambda *a, **kw: steps.append("fit") or fit(*a, **kw))
    monkeypatch.setattr(E, "stored", lambda df, name: steps.append(name) or keep(df, name))
    got = {r.fold: r for r in E.cross_validate(ratings, ("mf",), 3, 5, mf_params={"rank": 2, "max_iter": 2}).collect()}
    assert steps == ["folds"] + ["fit", "mf-errors"] * 3
    left = {t.rsplit("-", 1)[0] for t in tables(spark) - before}
    assert not left & {"train", "residuals", "without-items", "user-bias", "item-bias", "user-factors", "item-factors"}
    data = E.kfold(ratings, ["user_id", "item_id"], 3, 5)
    model = fit(data.filter("fold <> 1"), rank=2, max_iter=2, seed=6)
    want = R.rmse_mae(R.predict_pairs(model, data.filter("fold = 1"))).first()
    assert (got[1].model, got[1].n) == ("mf", want.n) and abs(got[1].rmse - want.rmse) < 1e-6 and abs(got[1].mae - want.mae) < 1e-6
    assert sum(r.n for r in got.values()) == ratings.count()


def test_als_keeps_nothing_in_the_heap(spark, monkeypatch):
    """Its blocks of all ratings and the factors lie on disk, where the heap of the executors does not bound them."""
    held, fit = [], R.ALS.fit

    def cached():
        return {i.id(): (i.name(), i.memSize(), i.diskSize()) for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()}

    def spy(self, data, *rest):
        before = cached()
        model = fit(self, data, *rest)
        held.extend(v for k, v in cached().items() if k not in before)
        return model

    drop_unreferenced(spark)
    monkeypatch.setattr(R.ALS, "fit", spy)
    model = R.fit_mf(ratings_of(spark), rank=2, max_iter=2, seed=1)
    assert {"userFactors", "itemFactors"} <= {name for name, _, _ in held} and all(m == 0 and d > 0 for _, m, d in held)
    assert model.user_factors.count() == 40


def test_users_reach_blocks_in_bounded_batches():
    """A user that may need all item blocks: what is computed and sent at once does not grow with their number."""
    users, blocks, rank = 300, 5000, 2
    table = [(k, 0.5, 1.0, k * 10, [-1.0] * rank, [1.0] * rank) for k in range(blocks)]
    rows = pa.RecordBatch.from_arrays([
        pa.array(range(users)), pa.array([[0.5] * rank] * users, pa.list_(pa.float64())), pa.array([0.0] * users), pa.array([1.0] * users),
        pa.array([None if u % 2 else 5.0 for u in range(users)], pa.float64()), pa.array([-1.0] * users)], ["user_id", "features", "b_u", "norm", "nth", "nth_id"])
    got = list(R._reach(table, 3.0, rank)([rows]))
    assert max(b.num_rows for b in got) <= R.REACH_BOUNDS and len(got) > 1
    of, block = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in (0, 4))
    assert set(of) == set(range(1, users, 2))  # the others' n-th score is the highest there is and no bound reaches it
    assert len(of) == 150 * (blocks - 2) and set(block) == set(range(2, blocks))


def test_best_of_judges_the_factorisation_too(spark, monkeypatch):
    """All candidates of the selection are cross-validated, and the factorisation wins when it is best or equal."""
    errors, asked = {"mf": 0.9, "bias": 0.9, "knn": 1.0, "normal": 1.5}, []

    def cross_validate(ratings, models, folds, seed, mf_params=None):
        asked.extend(models)
        return spark.createDataFrame([(x, f, errors[x] + f / 10, 0.5, 10) for x in models for f in range(folds)], "model string, fold int, rmse double, mae double, n long")

    model = SimpleNamespace(_stored=lambda name, sources, derive, write: derive())
    monkeypatch.setattr(learn, "_train", lambda m: None)
    monkeypatch.setattr(learn.E, "cross_validate", cross_validate)
    assert tuple(learn.best_of(model).first()) == ("mf", 1.0) and sorted(asked) == sorted(errors)
    errors["mf"] = 0.95
    assert tuple(learn.best_of(model).first()) == ("bias", 1.0)
