"""Resolution of not-modified revisit records in web archives.

A revisit record of the server-not-modified profile (a 304 answer) has no payload. It is resolved by an as-of join: the
latest response record with status 200 of the same canonical URL that is strictly earlier. The pair's validators are
checked (entity tags by weak comparison where both have one, else Last-Modified) and the revisit's permitted headers are
merged over the response's.

The as-of join works on two levels, so that a hot URL is no single sorted group: within (URL, time bucket) a window finds
the latest earlier response; a second window, over one row per URL and bucket, carries the latest response of earlier
buckets in. Times are compared to the microsecond. Of several responses of one URL at one time the one with the largest
record_id counts, of those with equal ids the one with the largest entity tag, Last-Modified, headers and payload. Payloads
are joined at the end, for found responses only, by id, URL and time; a null record_id is told apart by URL and time.

Outcomes: `verified`, `unverified` (no validator on both sides), `mismatch` (validators differ: headers and payload stay null),
`orphan` (no earlier response, or null URL or date). Null headers count as none. Repeated revisit rows are each resolved;
empty tables give empty results; payloads and URLs of any length are taken whole; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

BUCKET_SECONDS = 3600
# Header fields of a 304 answer that never replace the stored ones (they describe the missing body or the
# connection).
NOT_MERGED = ["content-length", "content-type", "content-encoding", "content-range", "content-md5", "transfer-encoding", "connection", "keep-alive",
              "proxy-authenticate", "proxy-connection", "te", "trailer", "upgrade"]


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no user info, default port or fragment, at least a slash as path; null stays null."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    tail = F.substring(u, F.length(head) + 1, F.length(u))
    host = F.regexp_replace(F.lower(head), "://[^@]*@", "://")
    host = F.regexp_replace(F.regexp_replace(host, "^(http://.*):80$", "$1"), "^(https://.*):443$", "$1")
    return F.concat(host, F.when(tail.startswith("/"), tail).otherwise(F.concat(F.lit("/"), tail)))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _lower_keys(headers: str) -> Column:
    """Header map with lower-case names; of names that differ in case only, the last value stays."""
    pairs = F.map_entries(F.coalesce(F.col(headers), F.expr("cast(map() as map<string,string>)")))
    names = F.array_distinct(F.transform(pairs, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda e: F.lower(e["key"]) == k), -1)["value"]))


def latest_before(points: DataFrame, asked: DataFrame, key: str, at: str, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """Rows of `asked` (key, at, ...) with `found`, the struct `point` of the latest row of `points` (key, at, point) of the
    same key strictly before `at`; null if there is none. `at` is a long, `bucket` in its unit."""
    points = points.groupBy(key, at).agg(F.max("point").alias("point"))
    slot = F.col(at) - F.pmod(F.col(at), F.lit(bucket).cast("long"))  # whole numbers: exact at any size
    extra = [c for c in asked.columns if c not in (key, at)]
    both = points.select(key, at, slot.alias("_slot"), "point", F.lit(None).cast(asked.select(F.struct(*extra)).schema[0].dataType).alias("_row")).unionByName(
        asked.select(key, at, slot.alias("_slot"), F.lit(None).cast(points.schema["point"].dataType).alias("point"), F.struct(*extra).alias("_row")))
    inside = Window.partitionBy(key, "_slot").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_near", F.last("point", ignorenulls=True).over(inside)).where("_row is not null").drop("point")
    # one row per key and bucket: its last response, then the last one of all earlier buckets
    slots = both.groupBy(key, "_slot").agg(F.max_by("point", F.when(F.col("point").isNotNull(), F.col(at))).alias("_last"))
    before = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).where("_carry is not null").drop("_last")
    return near.join(carried, [key, "_slot"], "left").select(key, at, "_row.*", F.coalesce("_near", "_carry").alias("found"))


def resolve_revisits(records: DataFrame, bucket: int = BUCKET_SECONDS) -> DataFrame:
    """records: record_id, warc_type, target_uri, warc_date (timestamp), status, headers (map), payload.

    Returns per revisit: record_id, canonical_url, warc_date, response_id, outcome, headers, payload.
    """
    rows = records.select("record_id", F.lower("warc_type").alias("kind"), canonical_url(F.col("target_uri")).alias("canonical_url"),
                          F.unix_micros(F.col("warc_date").cast("timestamp")).alias("at"), "status", _lower_keys("headers").alias("headers"))
    full = rows.where("kind = 'response' and status = 200 and canonical_url is not null and at is not null")
    points = full.select("canonical_url", "at", F.struct("record_id", "at", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified")).alias("point"))
    asked = rows.where("kind = 'revisit'").select("canonical_url", "at", "record_id", "headers")
    got = latest_before(points, asked, "canonical_url", "at", bucket * 1_000_000)
    etag, modified = F.col("headers")["etag"], F.col("headers")["last-modified"]
    outcome = (F.when(F.col("found").isNull(), "orphan")
               .when(etag.isNotNull() & F.col("found.etag").isNotNull(), F.when(_strong(etag) == _strong(F.col("found.etag")), "verified").otherwise("mismatch"))
               .when(modified.isNotNull() & F.col("found.modified").isNotNull(), F.when(modified == F.col("found.modified"), "verified").otherwise("mismatch"))
               .otherwise("unverified"))
    got = got.select("record_id", "canonical_url", F.timestamp_micros("at").alias("warc_date"), F.col("found.record_id").alias("response_id"), outcome.alias("outcome"),
                     F.map_filter("headers", lambda k, v: ~k.isin(NOT_MERGED)).alias("_new"),
                     F.when(outcome.isin("verified", "unverified"), F.struct(F.col("found.record_id").alias("id"), F.col("canonical_url").alias("url"), F.col("found.at").alias("at"))).alias("_key"))
    got = store(got, "revisits")  # no payload in it; read twice
    wanted = got.where("_key is not null").select("_key").distinct()
    # payloads move only for responses that a revisit found; of records alike in id, URL and time one stays, by the stated order
    stored = (records.where("lower(warc_type) = 'response' and status = 200")
              .select(F.struct(F.col("record_id").alias("id"), canonical_url(F.col("target_uri")).alias("url"), F.unix_micros(F.col("warc_date").cast("timestamp")).alias("at")).alias("_key"),
                      _lower_keys("headers").alias("_old"), F.col("payload").alias("_payload"))
              .join(wanted, "_key", "left_semi"))
    order = F.struct(F.col("_old")["etag"].alias("etag"), F.col("_old")["last-modified"].alias("modified"),
                     F.array_sort(F.map_entries("_old")).alias("headers"), F.col("_payload").alias("payload"))
    stored = stored.groupBy("_key").agg(F.max(order).alias("m")).select(
        "_key", F.map_from_entries(F.col("m.headers")).alias("_old"), F.col("m.payload").alias("_payload"))
    joined = got.join(stored, "_key", "left")
    merged = F.map_concat(F.map_filter("_old", lambda k, v: ~F.array_contains(F.map_keys("_new"), k)), "_new")
    usable = F.col("_key").isNotNull()
    return joined.select("record_id", "canonical_url", "warc_date", "response_id", "outcome", F.when(usable, merged).alias("headers"), F.when(usable, F.col("_payload")).alias("payload"))
