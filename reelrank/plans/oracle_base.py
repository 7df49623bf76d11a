"""SQL (DuckDB dialect) definitions of the ratings model over the driver
tables; every oracle query starts with this WITH list. They restate the
rules of `reelrank.sources.driver` and `reelrank.operators.quality`
(derived log) in plain SQL so results can be checked independently.
"""

MODEL_CTES = r"""
li_o AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS item_id, l.l_quantity, l.l_orderkey, l.l_linenumber,
         l.l_suppkey, epoch_us(o.o_orderdate) // 1000000 AS ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
ratings AS (
  SELECT user_id, item_id, CAST(least(10, ceil(l_quantity / 5)) * 0.5 AS DOUBLE) AS rating, ts AS "timestamp"
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id
          ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS rn
        FROM li_o) s
  WHERE rn = 1),
users AS (SELECT c_custkey AS user_id FROM customer),
n_part AS (SELECT count(*) AS n FROM part),
raw_items AS (
  SELECT p_partkey AS "movieId", p_name || ' (' || CAST(p_size + 1980 AS VARCHAR) || ')' AS title,
         replace(p_name, ' ', '|') || '|' || p_type AS genres
  FROM part),
items AS (
  SELECT "movieId" AS item_id, title,
         CAST(nullif(regexp_extract(title, '\((\d{4})\)', 1), '') AS INTEGER) AS release_year
  FROM raw_items),
item_genre_names AS (
  SELECT item_id, genre FROM (SELECT "movieId" AS item_id, unnest(string_split(genres, '|')) AS genre
                              FROM raw_items) s),
genres AS (
  SELECT CAST(dense_rank() OVER (ORDER BY name) AS BIGINT) AS genre_id, name
  FROM (SELECT DISTINCT genre AS name FROM item_genre_names) s),
item_genres AS (
  SELECT DISTINCT n.item_id, g.genre_id FROM item_genre_names n JOIN genres g ON n.genre = g.name),
raw_tags AS (
  SELECT user_id AS "userId", event_id % (SELECT n FROM n_part) AS "movieId",
         CASE WHEN event_type <> 'error' THEN event_type END AS tag,
         epoch_us(ts) // 1000000 AS "timestamp", event_id
  FROM events),
tags AS (
  SELECT CAST(dense_rank() OVER (ORDER BY tag) AS BIGINT) AS tag_id, tag
  FROM (SELECT DISTINCT tag FROM raw_tags WHERE tag IS NOT NULL) s),
item_tags AS (
  SELECT r."userId" AS user_id, r."movieId" AS item_id, t.tag_id, max(r."timestamp") AS "timestamp"
  FROM raw_tags r JOIN tags t ON r.tag = t.tag GROUP BY 1, 2, 3),
links AS (
  SELECT p_partkey AS item_id, lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS imdb_id,
         CASE WHEN p_partkey % 10 <> 0 THEN CAST(p_partkey * 7 + 1 AS VARCHAR) END AS tmdb_id
  FROM part),
name_words AS (
  SELECT DISTINCT p_partkey, w AS tag
  FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) s WHERE w <> ''),
genome_tags AS (
  SELECT CAST(dense_rank() OVER (ORDER BY tag) AS BIGINT) AS tag_id, tag FROM (SELECT DISTINCT tag FROM name_words) s),
genome_scores AS (
  SELECT w.p_partkey AS item_id, g.tag_id,
         CAST(CAST((w.p_partkey * 31 + g.tag_id * 7) % 1000 AS DOUBLE) / 1000 AS DECIMAL(10, 6)) AS relevance
  FROM name_words w JOIN genome_tags g ON w.tag = g.tag),
reco_pos AS (
  SELECT event_id, value, unnest(range(0, event_id % 5 + 1)) AS pos FROM events),
reco_items AS (
  SELECT r.event_id, r.pos, i.title AS movie, r.value / 100 - r.pos / 10 + r.event_id % 9973 / 30000000 AS score
  FROM reco_pos r JOIN items i ON i.item_id = (r.event_id + (r.pos % 3) * 11) % (SELECT n FROM n_part)),
reco_lists AS (
  SELECT event_id, list(movie ORDER BY pos) AS titles, list(score ORDER BY pos) AS scores, count(*) AS k
  FROM reco_items GROUP BY event_id),
reco_log AS (
  SELECT e.event_id, strftime(e.ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", e.ts AS ts, e.user_id,
         CASE e.event_type WHEN 'view' THEN 'collaborative_filtering' WHEN 'click' THEN 'cold_start'
                           WHEN 'purchase' THEN 'cold_start_fallback' END AS method,
         CAST(l.k AS INTEGER) AS num_recommendations, l.titles, l.scores
  FROM events e JOIN reco_lists l ON e.event_id = l.event_id
  WHERE e.event_type IS DISTINCT FROM 'error' AND e.event_id % 10 <> 0)
"""


def with_model(body: str) -> str:
    """Prefix an oracle body with the model CTEs. The body may start with
    further CTEs (`, name AS (...)`) or directly with SELECT."""
    body = body.strip()
    if body.startswith(","):
        return "WITH " + MODEL_CTES.strip() + "\n" + body
    return "WITH " + MODEL_CTES.strip() + "\n" + body
