"""Distributed prefix sums: consecutive numbers and running sums without a task that sees all rows.

Rows are range partitioned on their order and the partitioning is fixed in a stored table. Inside a partition the
numbering or the running sum is local; what stands before a partition is the sum over the earlier ones, one row for each.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelrank.session import stored

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number inside the partition below


def _before(totals: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """(group, _part, _before_<value>): sums over the earlier partitions of each group; a row for each partition of a group."""
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*group, "_part", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values])


def numbered(df: DataFrame, order: list, id_col: str) -> DataFrame:
    """df with consecutive numbers from 1 in the order given (columns that together are unique, or the numbers of equal rows
    are arbitrary but fixed)."""
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("_part", F.shiftright("_at", _ROW_BITS))
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    before = accumulate((n for _, n in counts), initial=0)
    offset = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "_part long, _before long")
    number = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("_before") + 1
    return rows.join(F.broadcast(offset), "_part").withColumn(id_col, number).drop("_part", "_at", "_before")


def running_sums(df: DataFrame, group: list[str], order: list[str], values: list[str]) -> DataFrame:
    """df (one row for each group and order) with `run_<value>`: the sum of the value over the rows of the group up to this
    one. A group of any size is spread over the range partitions; no window holds more than one of them."""
    rows = stored(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "running-sums")
    upto = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy(*group, "_part").agg(*[F.sum(v).alias(v) for v in values])
    local = rows.select("*", *[F.sum(v).over(upto).alias(f"run_{v}") for v in values])
    out = local.join(_before(totals, group, values), [*group, "_part"])
    return out.select(*df.columns, *[(F.col(f"run_{v}") + F.col(f"_before_{v}")).alias(f"run_{v}") for v in values])
