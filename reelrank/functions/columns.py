"""Column expressions (scalar functions). All are built-in Catalyst
expressions, so they stay inside whole-stage codegen; no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for equal results:
# activity buckets and their order (P13/P14), the popularity damping weight
# (P15), the rating scale (P20), the drift status labels (P27), the default
# method label.
BUCKET_LABELS = ["< 10 notes", "10-49 notes", "50-99 notes", "100-499 notes", "500+ notes"]
BUCKET_UPPER = [10, 50, 100, 500]
DAMPING = 100
RATING_MIN, RATING_MAX = 0.5, 5.0
STATUS_DRIFT, STATUS_NORMAL = "drift_detected", "normal"
UNKNOWN_METHOD = "unknown"
EPOCH_MS_CUTOFF = 100_000_000_000  # values above are epoch milliseconds (P12)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract_year(title) -> Column:
    """First `(dddd)` in the title as INT, NULL when absent."""
    year = F.regexp_extract(_c(title), r"\((\d{4})\)", 1)
    return F.when(year != "", year.cast("int"))


def split_genres(genres) -> Column:
    """Split on the literal vertical bar."""
    return F.split(_c(genres), r"\|")


def normalise_epoch(ts) -> Column:
    """Epoch milliseconds -> seconds; seconds pass unchanged."""
    c = _c(ts).cast("bigint")
    return F.when(c > F.lit(EPOCH_MS_CUTOFF), F.floor(c / 1000)).otherwise(c).cast("bigint")


def epoch_to_date(ts) -> Column:
    """UTC calendar day of an epoch-seconds value."""
    return F.to_date(F.timestamp_seconds(_c(ts)))


def ntz_to_epoch(ts) -> Column:
    """Epoch seconds of a TIMESTAMP_NTZ, independent of the session time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def count_bucket(n) -> Column:
    """Activity bucket label."""
    c = _c(n)
    expr = F.when(c < BUCKET_UPPER[0], BUCKET_LABELS[0])
    for upper, label in zip(BUCKET_UPPER[1:], BUCKET_LABELS[1:-1]):
        expr = expr.when(c < upper, label)
    return expr.otherwise(BUCKET_LABELS[-1])


def bucket_rank(n) -> Column:
    """1..5 order of the bucket."""
    c = _c(n)
    expr = F.when(c < BUCKET_UPPER[0], 1)
    for i, upper in enumerate(BUCKET_UPPER[1:], start=2):
        expr = expr.when(c < upper, i)
    return expr.otherwise(len(BUCKET_LABELS))


def damped_score(total, n, damping: int = DAMPING) -> Column:
    """(n * avg) / (n + damping) == sum / (n + damping)."""
    return _c(total) / (_c(n) + F.lit(damping))


def change_pct(current, baseline) -> Column:
    """|(cur - base) / base * 100| rounded to 2; NULL when base is 0."""
    b = _c(baseline)
    return F.when(b != 0, F.round(F.abs((_c(current) - b) / b * 100), 2))


def status_label(change, threshold) -> Column:
    """Strict comparison with the threshold."""
    return F.when(_c(change) > F.lit(threshold), STATUS_DRIFT).otherwise(STATUS_NORMAL)


def null_to_zero(x, integral: bool = False) -> Column:
    """P17."""
    return F.coalesce(_c(x), F.lit(0 if integral else 0.0))


def random_rating(seed: int, cols: tuple[str, ...] = ("user_id", "item_id")) -> Column:
    """Uniform on 0.5, 1.0, ..., 5.0, drawn by a hash of the row's keys."""
    return ((F.pmod(hash_order(list(cols), seed), F.lit(10)) + 1) * 0.5).cast("decimal(2,1)")


def clip_to_scale(est, lo: float = RATING_MIN, hi: float = RATING_MAX) -> Column:
    """P20."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), _c(est)))


def parse_iso_ts(ts) -> Column:
    """ISO-8601 text -> TIMESTAMP, NULL when unparsable."""
    return F.coalesce(F.try_to_timestamp(_c(ts)),
                      F.try_to_timestamp(_c(ts), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
                      F.try_to_timestamp(_c(ts), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def default_method(method) -> Column:
    """P23."""
    return F.coalesce(_c(method), F.lit(UNKNOWN_METHOD))


def hash_order(cols: list[str], seed: int) -> Column:
    """Reproducible pseudo-random order key (M1): the first 60 bits of md5("key|key|...|seed").

    Depends on the row's keys alone, not on partitioning, and any SQL engine with md5 can repeat it.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint")


def rating_double(col: str = "rating") -> Column:
    """Ratings are DECIMAL(2,1) at rest; aggregate them as DOUBLE (exact for half steps)."""
    return F.col(col).cast("double")


def units(x, digits: int = 4) -> Column:
    """A value with `digits` decimals as an exact integer count of 10^-digits."""
    return F.round(_c(x) * (10 ** digits)).cast("long")


def rounded_mean(total: str, count: str, digits: int = 4) -> Column:
    """Mean of raw values from their sum, rounded once; 0 without values."""
    return F.when(F.col(count) > 0, F.round(F.col(total) / F.col(count), digits)).otherwise(F.lit(0.0))


def mean_of_units(total_units: str, count: str, digits: int = 4) -> Column:
    """Mean of values given as integer units, rounded half up to `digits`
    with exact integer division (no binary rounding ties)."""
    q = F.expr(f"(2 * `{total_units}` + `{count}`) div (2 * `{count}`)")
    return F.when(F.col(count) > 0, q / float(10 ** digits)).otherwise(F.lit(0.0))
