"""Connected components of a link table by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node of the component; only nodes with a link appear.

    Every step's edges are written to the shared folder, so lineage stays short and lost executors cost one step. The
    loop ends when a step changes nothing (its number grows with the logarithm of the component size).
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = edges_stored = store(links.where(F.col(a) != F.col(b)).select(hi, lo), "edges")
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or mark["n"] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = mark
        # large star: every larger neighbour of u gets the smallest node around u
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours get the smallest of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        down = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept, edges = edges_stored, store(down.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        edges_stored = edges
        discard(kept)
