"""The ratings model: stored once per application, same rows as the inline plan."""

from reelrank.sources import driver

SF = "/root/testdata/sf0.001"


def test_ratings_stored_once_and_equal_to_inline(spark):
    m = driver.model(spark, SF)
    a = m.ratings()
    b = driver.model(spark, SF).ratings()
    assert a.inputFiles() == b.inputFiles()  # second call scans the stored table
    assert all("reelrank/ratings-" in f for f in a.inputFiles())
    inline = driver.model(spark, SF, store=False).ratings()
    cols = ["user_id", "item_id", "rating", "timestamp"]
    assert sorted(tuple(r) for r in a.select(cols).collect()) == sorted(tuple(r) for r in inline.select(cols).collect())
    assert a.count() == 5382  # FIXTURES.md: ratings at sf0.001


def test_fingerprint_changes_with_source(spark, tmp_path):
    p = tmp_path / "x.parquet"
    spark.range(3).write.parquet(str(p))
    f1 = driver._fingerprint(spark, [str(p)])
    spark.range(5).write.mode("overwrite").parquet(str(p))
    assert driver._fingerprint(spark, [str(p)]) != f1
