"""Registered queries of the training-data operators: each runs over its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import (centroids, ctw, decontam, langid, license_scan, neardup, packing, periodic, pii_crf, rule_ledger, simhash, suffix_dedup,
               warc_revisit)
from .common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def pack_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register
def op1_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it contains."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per license text found in a document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; fitted on the rows whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", 3) == 1
    model = langid.fit(docs.where(~held))
    return langid.identify(docs.select("doc_id", held.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


@register
def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), pack_vocabulary())


@register
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, threshold_pct=80)


@register
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings."""
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"))


@register
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_pii(table(spark, sf_dir, "documents"), pii_crf.fit(), keep=["doc_id"])


def archive_records(pages: DataFrame) -> DataFrame:
    """WARC records of a crawl of the pages: every page is one full response, ten seconds after the page before it; each is
    asked for again a day and a quarter later by a conditional request, answered 304 and recorded as a revisit. By page_id
    modulo 7 the revisit carries the page's entity tag (also in its weak form), only its date, a stale tag, or no
    validator."""
    at = (F.lit(1_600_000_000) + F.col("page_id") * 10).cast("long")
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    text = F.coalesce("html", F.lit(""))
    modified = F.concat(F.lit("day "), F.floor((at - 86400) / 86400).cast("string"))
    k = F.col("page_id") % 7
    sent = F.when(k < 2, tag).when(k == 2, F.concat(F.lit("W/"), tag)).when(k == 3, F.lit('"stale"'))
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit("response").alias("warc_type"), F.col("url").alias("target_uri"), F.timestamp_seconds(at).alias("warc_date"),
        F.lit(200).alias("status"), F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(text).cast("string"), F.lit("ETag"), tag,
                                                 F.lit("Last-Modified"), modified, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"), F.col("html").alias("payload"))
    again = F.map_filter(F.create_map(F.lit("ETag"), sent, F.lit("Last-Modified"), F.when(k == 4, modified), F.lit("Cache-Control"), F.concat(F.lit("max-age="), F.col("page_id").cast("string")),
                                      F.lit("Content-Length"), F.lit("0")), lambda _, v: v.isNotNull())
    revisit = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), F.lit("revisit").alias("warc_type"), F.col("url").alias("target_uri"),
                           F.timestamp_seconds(at + 108_000).alias("warc_date"), F.lit(304).alias("status"), again.alias("headers"), F.lit(None).cast("string").alias("payload"))
    return response.unionByName(revisit)


@register
def op8_not_modified_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit record of the pages' archive with its response, outcome, merged headers and payload digest."""
    got = warc_revisit.resolve_revisits(archive_records(table(spark, sf_dir, "pages")))
    h = F.col("headers")
    return got.select("record_id", "canonical_url", "response_id", "outcome", h["etag"].alias("etag"), h["cache-control"].alias("cache_control"),
                      h["content-type"].alias("content_type"), h["content-length"].alias("content_length"),
                      F.md5(F.col("payload").cast("binary")).alias("payload_md5"))


ORACLES["op8_not_modified_revisits"] = r"""
WITH u AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS url FROM pages),
p AS (SELECT page_id, html, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) AS head, url FROM u),
q AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(lower(head), '://[^@]*@', '://'), '^(http://.*):80$', ''), '^(https://.*):443$', '') AS head,
    substr(url, length(head) + 1) AS tail FROM p),
c AS (SELECT page_id, html, CASE WHEN html IS NULL AND head IS NULL THEN NULL WHEN tail LIKE '/%' THEN head || tail ELSE head || '/' || tail END AS canonical_url,
    1600000000 + page_id * 10 AS ts, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || floor((1600000000 + page_id * 10 - 86400) / 86400)::BIGINT AS modified FROM q),
r AS (SELECT page_id, canonical_url, ts + 108000 AS ts, page_id % 7 AS k, tag, modified FROM c),
j AS (SELECT r.page_id, r.canonical_url, r.k, r.tag AS own_tag, r.modified AS own_modified, c.page_id AS found, c.tag, c.modified, c.html
  FROM r ASOF LEFT JOIN c ON r.canonical_url = c.canonical_url AND r.ts > c.ts),
o AS (SELECT *, CASE WHEN found IS NULL THEN 'orphan'
    WHEN k < 3 THEN CASE WHEN own_tag = tag THEN 'verified' ELSE 'mismatch' END WHEN k = 3 THEN 'mismatch'
    WHEN k = 4 THEN CASE WHEN own_modified = modified THEN 'verified' ELSE 'mismatch' END ELSE 'unverified' END AS outcome FROM j)
SELECT page_id * 2 + 1 AS record_id, canonical_url, found * 2 AS response_id, outcome,
  CASE WHEN outcome IN ('verified', 'unverified') THEN CASE WHEN k < 2 THEN own_tag WHEN k = 2 THEN 'W/' || own_tag ELSE tag END END AS etag,
  CASE WHEN outcome IN ('verified', 'unverified') THEN 'max-age=' || page_id END AS cache_control,
  CASE WHEN outcome IN ('verified', 'unverified') THEN 'text/html' END AS content_type,
  CASE WHEN outcome IN ('verified', 'unverified') THEN octet_length(encode(coalesce(html, '')))::VARCHAR END AS content_length,
  CASE WHEN outcome IN ('verified', 'unverified') THEN md5(html) END AS payload_md5
FROM o
"""


@register
def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of all rules: the base rules' outcome, the verdicts of both versions of the quality policy (kept, kept_v2), and
    the rules that alone reject a document under the first (saved_by)."""
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    rows = rows.withColumn("base_failed", ~rule_ledger.passes(rule_ledger.BASE))
    rows = rule_ledger.apply_policy(rows, rule_ledger.QUALITY)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "fail_bits",
                       rule_ledger.passes(rule_ledger.STRICT).alias("kept_v2"), rule_ledger.saved_by(rule_ledger.QUALITY).alias("saved_by"))


_LEDGER_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words FROM d),
p AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
t AS (SELECT rid, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS n FROM t WHERE tri IS NOT NULL),
c AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
ll AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY rid),
m AS (SELECT d.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z\x{C0}-\x{10FFFF}]', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits
  FROM d JOIN w USING (rid) LEFT JOIN ll USING (rid) LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 14 * n_words)::BIGINT
    + 64 * (100 * n_upper > 60 * n_letters)::BIGINT + 128 * (100 * n_digits > 30 * word_chars)::BIGINT + 256 * (n_words > 100000)::BIGINT AS fail_bits FROM m)
"""
ORACLES["op9_rule_ledger"] = _LEDGER_SQL + r"""SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 63) = 0 AS kept, n_lines::BIGINT AS n_lines, fail_bits,
  (fail_bits & 511) = 0 AS kept_v2, CASE WHEN bit_count(fail_bits & 63) = 1 THEN fail_bits & 63 ELSE 0 END::BIGINT AS saved_by
FROM b
"""


@register
def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per policy version and rule, over the ledger of all documents: how many fail the rule, how many the policy keeps, and
    how many it would keep beside those without the rule."""
    got = rule_ledger.ablations(rule_ledger.ledger(table(spark, sf_dir, "documents"), keep=[]))
    return got.select("policy", F.col("version").cast("long").alias("version"), "rule", "failing", "kept", "regained")


ORACLES["quality_ablations"] = _LEDGER_SQL[:-1] + r""",
a(policy, version, mask) AS (VALUES ('base', 1, 3), ('quality', 1, 63), ('quality', 2, 511)),
n(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbol_share', 4), ('duplicate_lines', 8), ('short_words', 16), ('long_words', 32),
  ('upper_case', 64), ('digits', 128), ('too_long', 256))
SELECT policy, version::BIGINT AS version, rule, count_if(fail_bits & bit <> 0)::BIGINT AS failing, count_if(fail_bits & mask = 0)::BIGINT AS kept,
  count_if(fail_bits & mask = bit)::BIGINT AS regained
FROM b, a, n WHERE mask & bit <> 0 GROUP BY policy, version, rule
"""


@register
def op10_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTW and unigram scores of every document; the rows whose crc32(doc_id) mod 10 is 0 are held out of the training."""
    rows = ctw.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)
    return rows.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@register
def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every usable embedding, with a digest of its centroid."""
    rows, about = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    about = about.select("cluster", F.col("size").alias("cluster_size"), "cluster_inertia", F.sum("cluster_inertia").over(Window.partitionBy()).alias("inertia"),
                         digest.alias("centroid_sha256"))  # one row for each of the k centroids
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "cluster_size")


def _cluster_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS) -> str:
    """Lloyd rounds on integers: all vectors against the centroids as (cluster, dimension, value) rows."""
    near = """a{r} AS MATERIALIZED (SELECT vec_id, rid, min(d * 64 + c) AS best FROM (
  SELECT v.vec_id, v.rid, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r} c) GROUP BY ALL),
b{r} AS MATERIALIZED (SELECT vec_id, rid, (best % 64)::INT AS cluster, best // 64 AS distance FROM a{r})"""
    move = """c{n} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS x FROM (
  SELECT c.c, g.i, coalesce(any_value(t.m), any_value(c.x[g.i])) AS m FROM c{r} c, range(1, 65) g(i)
  LEFT JOIN (SELECT cluster, j, floor(sum(x)::HUGEINT::DOUBLE / count(*))::BIGINT AS m FROM (SELECT b.cluster, unnest(v.x) AS x, generate_subscripts(v.x, 1) AS j FROM b{r} b JOIN v USING (rid)) GROUP BY ALL) t
    ON t.cluster = c.c AND t.j = g.i GROUP BY ALL) GROUP BY c)"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, n=r + 1), near.format(r=r + 1)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, x FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k}),
{", ".join(steps)},
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia, count(*)::BIGINT AS cluster_size FROM b{rounds} GROUP BY cluster)
SELECT vec_id, b.cluster, b.distance::BIGINT AS distance, cluster_inertia, (SELECT sum(cluster_inertia) FROM i)::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256, cluster_size
FROM b{rounds} b JOIN i USING (cluster) JOIN c{rounds} c ON c.c = b.cluster
"""


ORACLES["op11_centroid_clusters"] = _cluster_sql()


@register
def op12_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where, with h = crc32(doc_id), g = h // 10 and n words, one document in ten (h % 10 = 0) repeats from
    its word a = g % n on the p = 1 + (n - a) // (3 + g % 8) words that start there."""
    words = F.array_compact(F.transform(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: F.when(w != "", w)))
    n, h = F.size(words).cast("long"), crc_mod("doc_id", 1 << 32)
    g = F.floor(h / 10)
    a = g % n
    p = F.floor((n - a) / (g % 8 + 3)) + 1
    block = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    again = F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    text = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), text).otherwise(F.col("text")).alias("text"))


@register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest periodic run of every document, digests of all runs and of the text without their repetitions."""
    found = periodic.find_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    length, period = top["length"], -top["period"]
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-top["start"]).alias("start"), length.alias("length"), period.alias("period"),
                        F.floor(length * 1000 / period).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
