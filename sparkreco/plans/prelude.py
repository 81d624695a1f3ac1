"""Common table expressions of the oracle queries, in DuckDB's SQL."""

VIEWS = """
x_orders AS (SELECT o_custkey AS user_id, l_partkey AS item_id,
  TIMESTAMP '2024-01-01' + to_seconds(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) * 1077) AS created_timestamp,
  CASE o_orderstatus WHEN 'F' THEN 'delivered_orders' WHEN 'P' THEN 'canceled_orders' ELSE 'other' END AS last_status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x_tracker AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, ts AS "timestamp",
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'favorite' WHEN 'purchase' THEN 'to_cart'
                  WHEN 'signup' THEN 'view_description' ELSE 'other' END AS action_type FROM events),
x_items AS (SELECT p_partkey AS item_id, p_name AS itemname, embedding AS fclip_embed,
  CAST(substr(p_brand, 7) AS INTEGER) AS catalogid FROM part LEFT JOIN embeddings ON vec_id = p_partkey),
x_categories AS (SELECT b AS catalogid, CASE WHEN b > 5 THEN [r, (b-1)//5+1, 200+b, 300+b, b] ELSE [r, b] END AS ids
  FROM (SELECT b, CASE b % 4 WHEN 0 THEN 7500 WHEN 1 THEN 7697 WHEN 2 THEN 17777 ELSE 999 END AS r
        FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS b FROM part))),
x_test_users AS (SELECT c_custkey AS user_id FROM customer UNION ALL SELECT 1000000 + c_custkey FROM customer WHERE c_custkey % 50 = 0),
o AS (SELECT user_id, item_id, last_status, min(created_timestamp) AS created_timestamp, CAST(last_status = 'delivered_orders' AS INTEGER) AS target
  FROM x_orders WHERE last_status IN ('delivered_orders', 'canceled_orders') GROUP BY ALL),
t AS (SELECT DISTINCT user_id, item_id, action_type, "timestamp" FROM x_tracker WHERE action_type IN ('page_view', 'favorite', 'to_cart')),
i AS (SELECT item_id, min(itemname) AS itemname, min(catalogid) AS catalogid, first(fclip_embed) AS fclip_embed FROM x_items GROUP BY item_id),
cut AS (SELECT created_timestamp AS cutoff FROM (SELECT created_timestamp, row_number() OVER (ORDER BY created_timestamp) - 1 AS rn, count(*) OVER () AS n FROM o)
  WHERE rn = CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)),
tr AS (SELECT o.* FROM o, cut WHERE created_timestamp <= cutoff),
te AS (SELECT o.* FROM o, cut WHERE created_timestamp > cutoff),
ref AS (SELECT max(created_timestamp) AS r FROM tr),
ev AS (SELECT user_id, item_id, created_timestamp AS "timestamp", 'order' AS action_type, CAST(5 AS DOUBLE) AS base FROM tr
  UNION ALL SELECT user_id, item_id, "timestamp", action_type, CAST(CASE action_type WHEN 'page_view' THEN 1 WHEN 'favorite' THEN 5 ELSE 10 END AS DOUBLE) FROM t, cut WHERE "timestamp" < cutoff),
inter AS (SELECT user_id, item_id, "timestamp", action_type,
  base * ln(1 + greatest(floor((epoch_us(r) - epoch_us("timestamp")) / CAST(86400000000 AS DOUBLE)), 1) / 5) AS weight FROM ev, ref),
d AS (SELECT * FROM o WHERE target = 1),
vw AS (SELECT * FROM t WHERE action_type = 'page_view'),
ue AS (SELECT user_id, item_id, created_timestamp AS "timestamp", 'purchase' AS event_type FROM o UNION ALL SELECT user_id, item_id, "timestamp", 'click' FROM t),
usr AS (SELECT DISTINCT user_id FROM x_test_users),
pop AS (SELECT item_id, n AS score, CAST(row_number() OVER (ORDER BY n DESC, item_id) - 1 AS INTEGER) AS pop_rank
  FROM (SELECT item_id, count(*) AS n FROM d GROUP BY 1)),
ses AS (SELECT DISTINCT user_id, CAST("timestamp" AS DATE) AS day, item_id FROM ue WHERE "timestamp" >= (SELECT max("timestamp") FROM ue) - INTERVAL 60 DAY),
cov AS (SELECT a.item_id AS item_x, b.item_id AS item_y, count(*) AS weight FROM ses a JOIN ses b ON a.user_id = b.user_id AND a.day = b.day AND a.item_id <> b.item_id
  GROUP BY 1, 2 ORDER BY weight DESC, 1, 2 LIMIT 2000000),
his AS (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY m, item_id) AS INTEGER) AS pos
  FROM (SELECT user_id, item_id, min("timestamp") AS m FROM ue GROUP BY 1, 2)),
rec AS (SELECT user_id, item_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS pos FROM (
  SELECT user_id, item_id, max(round(0.8 * weight + 0.2 * floor(epoch_us("timestamp") / CAST(1000000 AS DOUBLE)) / (SELECT max(floor(epoch_us("timestamp") / CAST(1000000 AS DOUBLE))) FROM inter), 6)) AS score
  FROM inter GROUP BY 1, 2) QUALIFY pos <= 5),
voc AS (SELECT item_id FROM (SELECT item_id, count(*) AS n FROM tr GROUP BY 1) ORDER BY n DESC, item_id LIMIT 2000),
bas AS (SELECT user_id, created_timestamp, item_id, last_status, count(*) OVER (PARTITION BY user_id, created_timestamp) AS size FROM tr WHERE item_id IN (SELECT item_id FROM voc)),
cps AS (SELECT a.item_id, b.item_id AS nbr_id, sum(CAST(1 AS DOUBLE) / a.size) AS w FROM bas a JOIN bas b ON a.user_id = b.user_id AND a.created_timestamp = b.created_timestamp
  AND (a.item_id <> b.item_id OR a.last_status <> b.last_status) WHERE a.size >= 2 GROUP BY 1, 2),
cop AS (SELECT item_id, nbr_id, strength, CAST(row_number() OVER (PARTITION BY item_id ORDER BY strength DESC, nbr_id) AS INTEGER) AS rank FROM (
  SELECT item_id, nbr_id, round(w / greatest(sum(w) OVER (PARTITION BY item_id), 1e-9), 6) AS strength FROM cps) WHERE strength > 0 QUALIFY rank <= 30),
cat AS (SELECT catalogid, item_id FROM i WHERE catalogid IS NOT NULL
  UNION SELECT c.catalogid, i.item_id FROM (SELECT catalogid, unnest(ids) AS id FROM x_categories) c JOIN i ON i.catalogid = c.id),
clist AS (SELECT catalogid, item_id, CAST(row_number() OVER (PARTITION BY catalogid ORDER BY pop_rank ASC NULLS LAST, item_id) AS INTEGER) AS nth FROM cat LEFT JOIN pop USING (item_id)),
uf AS (SELECT user_id, coalesce(n, 0) AS user_count, coalesce(s, 0) AS user_sum, coalesce(s / n, 0) AS user_mean, coalesce(hi, 0) AS user_max, coalesce(lo, 0) AS user_min, coalesce(c, 0) AS user_orders_count
  FROM (SELECT user_id, count(*) AS n, sum(weight) AS s, max(weight) AS hi, min(weight) AS lo FROM inter GROUP BY 1) FULL JOIN (SELECT user_id, count(*) AS c FROM tr GROUP BY 1) USING (user_id)),
itf AS (SELECT item_id, coalesce(n, 0) AS item_count, coalesce(s, 0) AS item_sum, coalesce(s / n, 0) AS item_mean, coalesce(hi, 0) AS item_max, coalesce(lo, 0) AS item_min, coalesce(c, 0) AS item_orders_count
  FROM (SELECT item_id, count(*) AS n, sum(weight) AS s, max(weight) AS hi, min(weight) AS lo FROM inter GROUP BY 1) FULL JOIN (SELECT item_id, count(*) AS c FROM tr GROUP BY 1) USING (item_id)),
uiw AS (SELECT user_id, item_id, sum(weight) AS weight FROM inter GROUP BY 1, 2)
"""


def sql(body: str, *more: str) -> str:
    """body after the views and further expressions."""
    return f"WITH {', '.join([VIEWS.strip(), *more])} {body}"


def filled(lists: str, k: int, name: str = "filled") -> str:
    """An expression: the lists (user_id, item_id, pos) of all test users, filled to k from the popularity list."""
    return f"""
{name} AS (SELECT user_id, item_id, pos FROM {lists}
  UNION ALL SELECT user_id, item_id, CAST(have + nth AS INTEGER) FROM (
    SELECT h.user_id, p.item_id, h.have, row_number() OVER (PARTITION BY h.user_id ORDER BY p.pop_rank) AS nth
    FROM (SELECT u.user_id, count(l.item_id) AS have FROM usr u LEFT JOIN {lists} l USING (user_id) GROUP BY 1) h
    JOIN pop p ON p.pop_rank < {k} AND h.have < {k}
    WHERE NOT EXISTS (SELECT 1 FROM {lists} l WHERE l.user_id = h.user_id AND l.item_id = p.item_id)) WHERE have + nth <= {k})"""


def first_seen(source: str, order: str, name: str, k: int | None = None) -> str:
    """An expression: items of (user_id, item_id, order...) once each, at the least of the order; positions counted anew."""
    cols = [c.strip() for c in order.split(",")]
    least = f"SELECT user_id, item_id, {', '.join(cols)} FROM {source} QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY {order}) = 1"
    cutoff = f" QUALIFY pos <= {k}" if k else ""
    return f"{name} AS (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY {order}, item_id) AS INTEGER) AS pos FROM ({least}){cutoff})"
