"""The ratings model over the driver's star schema.

Mapping (fixed by design, mirrored by the SQL oracles):

* users   = customer.c_custkey
* items   = part.p_partkey; title = "<p_name> (<1980 + p_size>)"; raw genres =
            the words of p_name plus p_type, joined by a vertical bar
* ratings = lineitem JOIN orders on the order key; user = o_custkey,
            item = l_partkey, rating = least(10, ceil(l_quantity / 5)) * 0.5,
            timestamp = epoch seconds of o_orderdate; one row per (user, item):
            the latest by (timestamp, l_orderkey, l_linenumber, l_suppkey,
            l_quantity), all descending
* raw tags = events: item = event_id % |part|, tag = NULL for 'error' events
* links derived from part; genome tags = distinct words of p_name, one
            genome score per (item, word of its name)

Every table is a lazy DataFrame; nothing is collected. The heavy one is
`ratings`: one hash join per partition of order keys (no side is sorted) and
one aggregate keyed on (user, item). Nearly every line has its own pair, so
the lines meet unmerged and are sorted once, behind the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelrank.functions.columns import ntz_to_epoch
from reelrank.session import no_shuffles_left, scratch_path

# Fixed values of the derived model.
TITLE_YEAR_BASE = 1980
ERROR_EVENT = "error"


# Ratings tables already written in this application: key -> path.
_STORED: dict[tuple, str] = {}


def _fingerprint(spark: SparkSession, paths: list[str]) -> tuple:
    """(length, modification time) of each source, through the Hadoop
    FileSystem API so any cluster file system works."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        st = fs.getFileStatus(path)
        out.append((p, fs.getContentSummary(path).getLength(), st.getModificationTime()))
    return tuple(out)


class DriverModel:
    """Lazy view of the ratings model for one scale-factor directory.

    With `store=True` (default) the derived ratings, items, genres and
    item_genres tables are written once per application into the shared
    checkpoint folder and every later query scans them, as the reference
    loads its tables once and queries them many times. The written table also cuts the lineage of
    downstream jobs. The key includes the size and modification time of the
    source files, so changed inputs are derived again.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, store: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.store = store

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- raw files (camelCase as in the CSV sources) -------------------------
    def raw_items(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("movieId"),
            F.concat(F.col("p_name"), F.lit(" ("), (F.col("p_size") + TITLE_YEAR_BASE).cast("string"),
                     F.lit(")")).alias("title"),
            F.concat(F.regexp_replace("p_name", " ", "|"), F.lit("|"), F.col("p_type")).alias("genres"),
        )

    def raw_ratings(self) -> DataFrame:
        r = self.ratings()
        return r.select(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"),
                        "rating", "timestamp")

    def raw_tags(self) -> DataFrame:
        e = self.table("events")
        n_items = self.table("part").select(F.count(F.lit(1))).scalar()
        return e.select(
            F.col("user_id").alias("userId"),
            F.pmod(F.col("event_id"), n_items).alias("movieId"),
            F.when(F.col("event_type") != ERROR_EVENT, F.col("event_type")).alias("tag"),
            ntz_to_epoch("ts").alias("timestamp"),
        )

    def raw_links(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("movieId"),
            F.lpad(F.col("p_partkey").cast("string"), 7, "0").alias("imdbId"),
            F.when(F.pmod("p_partkey", F.lit(10)) != 0,
                   (F.col("p_partkey") * 7 + 1).cast("string")).alias("tmdbId"),
        )

    def _name_words(self) -> DataFrame:
        p = self.table("part")
        return (p.select("p_partkey", F.explode(F.split(F.col("p_name"), " ")).alias("tag"))
                .filter(F.col("tag") != "").distinct())

    def raw_genome_tags(self) -> DataFrame:
        # Genome tags are the distinct words of the item names; ids by name order
        # over the small distinct set.
        from reelrank.operators.ingest import dense_ids
        return dense_ids(self._name_words().select("tag"), "tag", "tagId")

    def raw_genome_scores(self) -> DataFrame:
        # One score per (item, word of its name).
        tags = self.raw_genome_tags()
        return (self._name_words().join(tags, "tag")
                .select(F.col("p_partkey").alias("movieId"), "tagId",
                        (F.pmod(F.col("p_partkey") * 31 + F.col("tagId") * 7, F.lit(1000)) / 1000)
                        .cast("decimal(10,6)").alias("relevance")))

    # -- normalised tables ---------------------------------------------------
    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user_id"))

    def _stored(self, name: str, sources: list[str], derive, write) -> DataFrame:
        """Derive once per application and input fingerprint, then scan the stored table."""
        if not self.store:
            return derive()
        src = [f"{self.sf_dir}/{t}.parquet" for t in sources]
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name, _fingerprint(self.spark, src))
        path = _STORED.get(key)
        if path is None:
            path = write(derive(), scratch_path(self.spark, name))
            _STORED[key] = path
        return self.spark.read.parquet(path)

    def ratings(self) -> DataFrame:
        return self._stored("ratings", ["lineitem", "orders"], self.derive_ratings, write_ratings)

    def derive_ratings(self) -> DataFrame:
        """ratings from lineitem JOIN orders (one row per user and item)."""
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        j = li.join(o.hint("shuffle_hash"), li.l_orderkey == o.o_orderkey).withColumnsRenamed({"o_custkey": "user_id", "l_partkey": "item_id"})
        latest = F.max(F.struct(
            ntz_to_epoch("o_orderdate").alias("ts"), F.col("l_orderkey"), F.col("l_linenumber"),
            F.col("l_suppkey"), F.col("l_quantity")))
        agg = j.repartition("user_id", "item_id").groupBy("user_id", "item_id").agg(latest.alias("m"))
        return agg.select(
            "user_id", "item_id",
            (F.least(F.lit(10.0), F.ceil(F.col("m.l_quantity") / 5)) * 0.5).cast("decimal(2,1)").alias("rating"),
            F.col("m.ts").alias("timestamp"))

    def items(self) -> DataFrame:
        from reelrank.operators.ingest import normalise_items
        return self._stored("items", ["part"], lambda: normalise_items(self.raw_items()), _write)

    def genres(self) -> DataFrame:
        from reelrank.operators.ingest import genres_from_items
        return self._stored("genres", ["part"], lambda: genres_from_items(self.raw_items()), _write)

    def item_genres(self) -> DataFrame:
        from reelrank.operators.ingest import item_genres_from_items
        return self._stored("item_genres", ["part"],
                            lambda: item_genres_from_items(self.raw_items(), self.genres()), _write)

    def tags(self) -> DataFrame:
        from reelrank.operators.ingest import tags_from_raw
        return tags_from_raw(self.raw_tags())

    def item_tags(self) -> DataFrame:
        from reelrank.operators.ingest import item_tags_from_raw
        return item_tags_from_raw(self.raw_tags(), self.tags())

    def links(self) -> DataFrame:
        from reelrank.operators.ingest import rename_columns
        return rename_columns(self.raw_links(), "links")

    def genome_tags(self) -> DataFrame:
        from reelrank.operators.ingest import rename_columns
        return rename_columns(self.raw_genome_tags(), "genome_tags")

    def genome_scores(self) -> DataFrame:
        from reelrank.operators.ingest import rename_columns
        return rename_columns(self.raw_genome_scores(), "genome_scores")

    def events(self) -> DataFrame:
        """Request events with `ts` as a zoned TIMESTAMP (watermarks reject NTZ)."""
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))


def _write(df: DataFrame, path: str) -> str:
    with no_shuffles_left(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return path


def write_ratings(ratings: DataFrame, path: str) -> str:
    """Store a ratings table: files sorted by (user, item) inside, so
    per-user filters skip row groups by their min/max statistics."""
    return _write(ratings.sortWithinPartitions("user_id", "item_id"), path)


def model(spark: SparkSession, sf_dir: str, store: bool = True) -> DriverModel:
    return DriverModel(spark, sf_dir, store)
