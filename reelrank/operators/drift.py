"""Drift detection (D1-D4, D6, A27) against a stored baseline.

D1 compares two one-row statistics records in long form (`stack`), so the
per-metric rule is a projection and the verdict a `bool_or`. D3 is a
two-sample Kolmogorov-Smirnov test per column computed relationally: count
each value in both samples, distributed running sums per column ordered by
value, D = max |F_a - F_b|, and the asymptotic p-value as a column expression.
D2 and D6 work on versioned snapshots: a check reads the latest snapshot as of
its time, and where there is none its own statistics become the baseline.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelrank.functions.columns import change_pct, status_label
from reelrank.operators.prefix import running_sums

DRIFT_METRICS = ["avg_rating", "num_users", "num_movies", "num_ratings"]
KS_TERMS = 20  # terms of the Kolmogorov series; below lambda 0.2 the p-value is 1 to double precision


def _long_stats(stats: DataFrame, value_name: str) -> DataFrame:
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in DRIFT_METRICS)
    return stats.selectExpr(f"stack({len(DRIFT_METRICS)}, {pairs}) AS (metric, {value_name})")


def detect_drift(current: DataFrame, baseline: DataFrame, threshold_pct: float = 10.0) -> DataFrame:
    """D1 + P16 + P27: one row per metric whose baseline is not 0."""
    cur = _long_stats(current, "current")
    base = _long_stats(baseline, "baseline")
    rows = base.join(cur, "metric").filter(F.col("baseline") != 0)
    chg = change_pct(F.col("current"), F.col("baseline"))
    # status uses the unrounded change, as the reference compares before rounding
    raw = F.abs((F.col("current") - F.col("baseline")) / F.col("baseline") * 100)
    return rows.select("metric", "baseline", "current", chg.alias("change_pct"),
                       status_label(raw, threshold_pct).alias("status"))


def drift_verdict(drift_rows: DataFrame, threshold_pct: float = 10.0) -> DataFrame:
    """One-row verdict: any metric drifted."""
    return drift_rows.agg(
        F.coalesce(F.bool_or(F.col("status") == "drift_detected"), F.lit(False)).alias("drift_detected"),
        F.count(F.lit(1)).alias("metrics_checked")).withColumn("threshold_pct", F.lit(float(threshold_pct)))


def ks_statistic(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """D3: per column, two-sample K-S statistic D, sample sizes and p-value.

    Values are counted per (column, value) first, so ties are handled per
    value; the running sums over the distinct values of a column are spread
    over range partitions (`running_sums`), whatever their number.
    """
    def long(df, side):
        stacked = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in columns)
        return df.selectExpr(f"stack({len(columns)}, {stacked}) AS (column, value)").withColumn("side", F.lit(side))

    both = long(a, "a").unionByName(long(b, "b")).filter(F.col("value").isNotNull())
    counts = both.groupBy("column", "value").agg(
        F.count(F.when(F.col("side") == "a", 1)).alias("ca"), F.count(F.when(F.col("side") == "b", 1)).alias("cb"))
    sums = running_sums(counts, ["column"], ["value"], ["ca", "cb"])
    sizes = counts.groupBy("column").agg(F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"))
    apart = F.abs(F.try_divide("run_ca", "n_a") - F.try_divide("run_cb", "n_b"))  # NULL where a sample is empty
    d = sums.join(sizes, "column").groupBy("column", "n_a", "n_b").agg(F.max(apart).alias("ks_stat"))
    return d.select("column", F.round("ks_stat", 10).alias("ks_stat"), "n_a", "n_b",
                    F.round(ks_pvalue(F.col("ks_stat"), F.col("n_a"), F.col("n_b")), 6).alias("p_value"))


def ks_pvalue(d, n_a, n_b):
    """Asymptotic two-sided p-value: Q(lambda) = 2 sum (-1)^(k-1) exp(-2 k^2 lambda^2),
    lambda = (sqrt(ne) + 0.12 + 0.11 / sqrt(ne)) * D, ne = n_a n_b / (n_a + n_b)."""
    ne = F.nullif(n_a * n_b / (n_a + n_b), F.lit(0.0))
    lam = (F.sqrt(ne) + 0.12 + 0.11 / F.sqrt(ne)) * d
    series = F.lit(0.0)
    for k in range(1, KS_TERMS + 1):
        series = series + F.lit((-1.0) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
    p = F.lit(2.0) * series
    return F.when((d <= 0) | (lam < 0.2), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def ks_drift(baseline_rows: DataFrame, current_rows: DataFrame, columns: list[str] | None = None,
             alpha: float = 0.05) -> DataFrame:
    """D3: per-column drift flag (p < alpha)."""
    cols = columns or ["user_id", "item_id", "rating", "timestamp"]
    ks = ks_statistic(baseline_rows, current_rows, cols)
    return ks.withColumn("drift_detected", F.col("p_value") < alpha)


def drift_summary(ks_rows: DataFrame) -> DataFrame:
    """D4 + A27: drifted-column count, sample sizes, overall flag."""
    return ks_rows.agg(
        F.count(F.when(F.col("drift_detected"), 1)).alias("drifted_columns"),
        F.count(F.lit(1)).alias("columns_tested"),
        F.max("n_a").alias("baseline_size"), F.max("n_b").alias("current_size"),
    ).withColumn("drift_detected", F.col("drifted_columns") > 0)


METHODS = ("stats", "ks")


def drift_with_fallback(baseline_rows: DataFrame, current_rows: DataFrame, method: str = "stats", threshold_pct: float = 10.0,
                        alpha: float = 0.05, columns: list[str] | None = None) -> DataFrame:
    """One verdict row by either method: `stats` compares the statistics records (D1), `ks` the distributions (D3). The
    distributional check needs both samples; where one is empty it falls back to the statistics, and `method` says so."""
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}")
    from reelrank.operators.analytics import data_statistics

    if method == "ks":
        ks = ks_drift(baseline_rows, current_rows, columns, alpha)
        out = ks.agg(F.count(F.when(F.col("drift_detected"), 1)).alias("drifted"), F.count(F.lit(1)).alias("checked"),
                     F.coalesce(F.min(F.least("n_a", "n_b")), F.lit(0)).alias("smaller"))
        by_ks = out.filter("smaller > 0").select(F.lit("ks").alias("method"), "drifted", "checked")
        by_stats = _stats_verdict(data_statistics(current_rows), data_statistics(baseline_rows), threshold_pct)
        both = by_ks.withColumn("_p", F.lit(0)).unionByName(by_stats.withColumn("_p", F.lit(1)))
        out = both.orderBy("_p").limit(1).drop("_p")
    else:
        out = _stats_verdict(data_statistics(current_rows), data_statistics(baseline_rows), threshold_pct)
    return out.withColumn("drift_detected", F.col("drifted") > 0)


def _stats_verdict(current: DataFrame, baseline: DataFrame, threshold_pct: float) -> DataFrame:
    rows = detect_drift(current, baseline, threshold_pct)
    return rows.agg(F.lit("stats").alias("method"), F.count(F.when(F.col("status") == "drift_detected", 1)).alias("drifted"),
                    F.count(F.lit(1)).alias("checked"))


# -- versioned snapshots (D2, D6) -----------------------------------------------------------------------------------------


def period_statistics(ratings: DataFrame, period) -> DataFrame:
    """(period, as_of, the compared statistics) for each period of the ratings; as_of is the period's last rating time."""
    r = F.col("rating").cast("double")
    return ratings.groupBy(period.alias("period")).agg(
        F.max("timestamp").alias("as_of"), F.min("timestamp").alias("since"), F.avg(r).alias("avg_rating"), F.count_distinct("user_id").alias("num_users"),
        F.count_distinct("item_id").alias("num_movies"), F.count(F.lit(1)).alias("num_ratings"))


def as_of(checks: DataFrame, versions: DataFrame, time: str = "since", version: str = "as_of", name: str = "dataset") -> DataFrame:
    """checks with `baseline_version`: the latest version of the same dataset before the check's time, NULL without one. The
    versions are merged into the checks by time; a dataset's timeline has a row for each check and version."""
    line = checks.select(name, F.col(time).alias("_t"), F.lit(0).alias("_v")).distinct().unionByName(
        versions.select(name, F.col(version).alias("_t"), F.lit(1).alias("_v")).distinct())
    before = Window.partitionBy(name).orderBy("_t", "_v").rowsBetween(Window.unboundedPreceding, -1)
    found = line.withColumn("baseline_version", F.max(F.when(F.col("_v") == 1, F.col("_t"))).over(before))
    found = found.filter("_v = 0").select(name, F.col("_t").alias(time), "baseline_version")
    return checks.join(found, [name, time])


def baseline_checks(current: DataFrame, snapshots: DataFrame, threshold_pct: float = 10.0) -> DataFrame:
    """D2 for many checks: each is compared with the snapshot as of its start, or becomes the baseline where none exists.

    current: dataset, period, since and the compared statistics; snapshots: dataset, as_of and the same statistics."""
    checks = as_of(current, snapshots)
    base = snapshots.select("dataset", F.col("as_of").alias("baseline_version"), *[F.col(c).cast("double").alias(f"_{c}") for c in DRIFT_METRICS])
    rows = checks.join(base, ["dataset", "baseline_version"], "left")
    created = F.col("baseline_version").isNull()
    drifted, checked = F.lit(0), F.lit(0)
    for c in DRIFT_METRICS:
        usable = F.coalesce(F.col(f"_{c}") != 0, F.lit(False))
        moved = F.abs((F.col(c) - F.col(f"_{c}")) / F.col(f"_{c}") * 100) > threshold_pct
        checked += usable.cast("int")
        drifted += F.when(usable, moved.cast("int")).otherwise(0)
    return rows.select("dataset", "period", F.when(created, "baseline_created").otherwise("compared").alias("status"), "baseline_version",
                       checked.alias("metrics_checked"), drifted.alias("metrics_drifted"), (drifted > 0).alias("drift_detected"))


def observed_schema(cells: DataFrame, by: list[str]) -> DataFrame:
    """(by, name, type): the columns that deliver a value in each group, with the narrowest type that holds their values
    (bigint, double or string). cells: by, name, value (text, NULL: no value)."""
    v = F.col("value")
    whole = v.rlike(r"^[+-]?[0-9]+$")
    number = v.rlike(r"^[+-]?[0-9]*\.?[0-9]+([eE][+-]?[0-9]+)?$")
    kind = F.when(F.bool_and(whole), "bigint").when(F.bool_and(number), "double").otherwise("string")
    return cells.filter(v.isNotNull()).groupBy(*by, "name").agg(kind.alias("type"))


def schema_changes(current: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """D6 per group: columns of the baseline and now, names added, missing or of another type, and the verdict."""
    both = baseline.withColumnRenamed("type", "_was").join(current.withColumnRenamed("type", "_is"), [*by, "name"], "full")

    def names(condition):
        return F.array_join(F.array_sort(F.collect_list(F.when(condition, F.col("name")))), ",")

    added, missing = F.col("_was").isNull(), F.col("_is").isNull()
    out = both.groupBy(*by).agg(F.count("_was").alias("baseline_columns"), F.count("_is").alias("current_columns"), names(added).alias("added"),
                                names(missing).alias("missing"), names(F.col("_was") != F.col("_is")).alias("type_changed"))
    return out.withColumn("drift_detected", F.concat("added", "missing", "type_changed") != "")


def schema_drift(baseline: DataFrame, current: DataFrame) -> dict:
    """Compare column names and types of two frames (driver-side metadata only)."""
    b = {f.name: f.dataType.simpleString() for f in baseline.schema.fields}
    c = {f.name: f.dataType.simpleString() for f in current.schema.fields}
    return {"baseline_columns": len(b), "current_columns": len(c),
            "missing": sorted(set(b) - set(c)), "added": sorted(set(c) - set(b)),
            "type_changed": sorted(k for k in set(b) & set(c) if b[k] != c[k]),
            "drift_detected": b != c}

