"""Building blocks for the DuckDB oracle SQL (brute-force reference).

The oracle is written as plain ANSI SQL over the driver views and states
each operator's semantics the direct way (global windows, full joins) —
deliberately independent of the Spark plans.
"""

# interactions / filter / split used by most oracle queries
INTERACTIONS = """interactions AS (
  SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
         CAST(1 + floor((l.l_quantity - 1) / 10) AS DOUBLE) AS rating,
         CAST(l.l_shipdate AS TIMESTAMP) AS ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

FILTERED = """filtered AS (
  SELECT * FROM interactions
  WHERE item_id IN (SELECT item_id FROM interactions GROUP BY item_id HAVING count(*) >= 10))"""

SPLIT = """numbered AS (
  SELECT *, row_number() OVER (ORDER BY ts, user_id, item_id, rating) AS rn,
         count(*) OVER () AS n_all
  FROM filtered),
split AS (
  SELECT user_id, item_id, rating, ts,
         CASE WHEN rn <= CAST(floor((CAST(1.0 AS DOUBLE) - CAST(0.2 AS DOUBLE)) * n_all) AS BIGINT)
              THEN 'train' ELSE 'test' END AS split
  FROM numbered),
train AS (SELECT user_id, item_id, rating, ts FROM split WHERE split = 'train'),
test AS (SELECT user_id, item_id, rating, ts FROM split WHERE split = 'test')"""

FEEDBACK = """feedback AS (
  SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
         CASE event_type WHEN 'click' THEN 3.0 WHEN 'add_to_cart' THEN 4.0
                         WHEN 'purchase' THEN 5.0 WHEN 'ignore' THEN 2.0 END AS rating,
         CAST(ts AS TIMESTAMP) AS ts, event_type AS interaction_type
  FROM events),
new_ratings AS (
  SELECT user_id, item_id, rating, ts, 'implicit' AS source FROM feedback WHERE rating IS NOT NULL)"""

# popularity top-10 minus seen on the split
POP_TOP10 = """pop AS (
  SELECT item_id, count(*) AS popularity_score,
         row_number() OVER (ORDER BY count(*) DESC, item_id) AS prank
  FROM train GROUP BY item_id),
seen AS (SELECT DISTINCT user_id, item_id FROM train),
tusers AS (SELECT DISTINCT user_id FROM train),
pop_cand AS (
  SELECT u.user_id, p.item_id, p.prank, p.popularity_score
  FROM tusers u CROSS JOIN pop p
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item_id = p.item_id)),
pop_recs AS (
  SELECT user_id, item_id, CAST(popularity_score AS DOUBLE) AS score,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY prank) AS INTEGER) AS rank
  FROM pop_cand QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY prank) <= 10)"""

# per-user ranking components of pop_recs vs test (k = 10)
RANK_COMPONENTS = """rel AS (SELECT DISTINCT user_id, item_id FROM test),
nrel AS (SELECT user_id, count(*) AS n_relevant FROM rel GROUP BY user_id),
rj AS (
  SELECT r.user_id, r.rank, CASE WHEN rel.item_id IS NULL THEN 0 ELSE 1 END AS hit
  FROM pop_recs r LEFT JOIN rel ON r.user_id = rel.user_id AND r.item_id = rel.item_id
  WHERE r.rank <= 10),
rjc AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS pos,
         sum(hit) OVER (PARTITION BY user_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum
  FROM rj),
per AS (
  SELECT p.user_id, count(*) AS n_recs, sum(hit) AS hits,
         sum(hit / log2(pos + 1)) AS dcg,
         sum(CASE WHEN hit = 1 THEN cum / pos ELSE 0 END) AS ap_sum, max(n.n_relevant) AS n_relevant
  FROM rjc p JOIN nrel n ON p.user_id = n.user_id GROUP BY p.user_id),
idcg AS (
  SELECT m, sum(1.0 / log2(i + 1)) AS idcg
  FROM (SELECT DISTINCT least(n_relevant, 10) AS m FROM per
        UNION SELECT DISTINCT least(n_relevant, n_recs) FROM per) ms,
       range(1, 11) t(i)
  WHERE i <= m GROUP BY m)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
