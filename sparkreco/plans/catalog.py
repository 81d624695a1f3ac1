"""The queries by name, each beside the SQL that states the same for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreco.functions import scalar as S
from sparkreco.operators import candidates as C
from sparkreco.operators import als, clean, learning, reports, signals, sinks
from sparkreco.operators.boosting import Booster
from sparkreco.operators.factors import FactorStore
from sparkreco.operators.pairs import look_up, store_pairs
from sparkreco.operators.recommender import FEATURES, Recommender, category_shares, item_extras
from sparkreco.operators.vectors import VectorIndex
from sparkreco.plans.frames import Frames
from sparkreco.plans.prelude import filled, first_seen, sql
from sparkreco.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = 100


def query(oracle: str | None = None):
    def add(f: Callable[[Frames], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Frames(spark, folder))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def us(column: str, name: str):
    return S.micros(column).alias(name)


_EXTRAS = (
    "ui AS (SELECT DISTINCT user_id, item_id FROM inter)",
    "cs AS (SELECT item_id, CAST(sum(n) AS BIGINT) AS covisit_strength FROM (SELECT n, unnest([a, b]) AS item_id FROM (SELECT x.item_id AS a, y.item_id AS b, count(*) AS n FROM ui x JOIN ui y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2) WHERE n >= 5) GROUP BY 1)",
    "sh AS (SELECT user_id, catalogid, w / sum(w) OVER (PARTITION BY user_id) AS share FROM (SELECT user_id, catalogid, sum(weight) AS w FROM uiw JOIN i USING (item_id) GROUP BY 1, 2))",
)


# scans


@query(sql("SELECT user_id, item_id, epoch_us(created_timestamp) AS ts_us, last_status FROM x_orders"))
def scan_orders(f):
    return f.raw.orders.select("user_id", "item_id", us("created_timestamp", "ts_us"), "last_status")


@query(sql('SELECT user_id, item_id, epoch_us("timestamp") AS ts_us, action_type FROM x_tracker'))
def scan_tracker(f):
    return f.raw.tracker.select("user_id", "item_id", us("timestamp", "ts_us"), "action_type")


@query(sql("SELECT item_id, itemname, catalogid, CAST(coalesce(len(fclip_embed), 0) AS INTEGER) AS dims FROM x_items"))
def scan_items(f):
    return f.raw.items.select("item_id", "itemname", "catalogid", F.coalesce(F.when(F.col("fclip_embed").isNotNull(), F.size("fclip_embed")), F.lit(0)).alias("dims"))


@query(sql("SELECT catalogid, array_to_string(ids, '/') AS catalogpath, CAST(len(ids) AS INTEGER) AS depth FROM x_categories"))
def scan_categories(f):
    return f.categories.select("catalogid", "catalogpath", F.size("ids").alias("depth"))


@query(sql("SELECT user_id FROM usr"))
def test_users(f):
    return tables.distinct_users(f.raw.test_users)


@query(sql("SELECT user_id, item_id, last_status FROM o ORDER BY user_id, item_id, last_status LIMIT 1000"))
def sample_first_n(f):
    return tables.first_rows(f.orders.select("user_id", "item_id", "last_status"), 1000, "user_id", "item_id", "last_status")


@query(sql("SELECT user_id, item_id, last_status FROM o ORDER BY user_id, item_id, last_status LIMIT 500 OFFSET 1000"))
def chunk_scan(f):
    return tables.rows_between(f.orders.select("user_id", "item_id", "last_status"), 1000, 500, "user_id", "item_id", "last_status")


@query()
def bernoulli_sample(f):
    return tables.bernoulli_sample(f.raw.tracker.select("user_id", "item_id", "action_type"), 1000)


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def row_counts(f):
    return tables.concat([f.raw.table(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("customer", "events", "lineitem", "orders", "part")])


@query(sql('SELECT user_id, item_id FROM o UNION ALL SELECT user_id, item_id FROM t'))
def concat_parts(f):
    return tables.concat([f.orders.select("user_id", "item_id"), f.tracker.select("user_id", "item_id")])


# filters and projections


@query(sql("SELECT user_id, item_id, last_status, epoch_us(created_timestamp) AS ts_us, target FROM o"))
def clean_orders(f):
    return f.orders.select("user_id", "item_id", "last_status", us("created_timestamp", "ts_us"), "target")


@query(sql('SELECT user_id, item_id, action_type, epoch_us("timestamp") AS ts_us FROM t'))
def clean_tracker(f):
    return f.tracker.select("user_id", "item_id", "action_type", us("timestamp", "ts_us"))


@query(sql("SELECT item_id, itemname, catalogid FROM i"))
def clean_items(f):
    return f.items.select("item_id", "itemname", "catalogid")


@query(sql("SELECT user_id, item_id, epoch_us(created_timestamp) AS ts_us FROM x_orders WHERE last_status = 'delivered_orders'"))
def delivered_only(f):
    return clean.delivered_only(f.raw.orders).select("user_id", "item_id", us("created_timestamp", "ts_us"))


@query(sql("SELECT user_id, item_id, last_status FROM x_orders WHERE last_status <> 'canceled_orders'"))
def not_canceled(f):
    return clean.not_canceled(f.raw.orders).select("user_id", "item_id", "last_status")


@query(sql("""SELECT DISTINCT user_id, item_id, action_type, epoch_us("timestamp") AS ts_us FROM x_tracker WHERE action_type IN ('page_view', 'favorite', 'to_cart', 'view_description')"""))
def four_actions(f):
    return clean.clean_tracker(f.raw.tracker, ("page_view", "favorite", "to_cart", "view_description")).select("user_id", "item_id", "action_type", us("timestamp", "ts_us"))


@query(sql("SELECT item_id, catalogid FROM i WHERE catalogid IN (SELECT catalogid FROM x_categories WHERE list_has_any(ids, [7500, 17777, 7697]))"))
def category_items(f):
    return clean.items_under(f.items, f.categories).select("item_id", "catalogid")


@query(sql("SELECT item_id, catalogid FROM i WHERE catalogid IN (SELECT catalogid FROM x_categories WHERE list_has_any(ids, [7500, 17777, 7697]) AND len(ids) = 5)"))
def apparel_leaf_items(f):
    return clean.items_under(f.items, f.categories, depth=5).select("item_id", "catalogid")


@query(sql("SELECT t.user_id, t.item_id, action_type FROM t WHERE item_id IN (SELECT item_id FROM d)"))
def semi_filter(f):
    return f.tracker.join(f.delivered.select("item_id"), "item_id", "left_semi").select("user_id", "item_id", "action_type")


@query(sql('SELECT user_id, item_id, epoch_us("timestamp") AS ts_us, action_type FROM t WHERE "timestamp" >= (SELECT max("timestamp") FROM t) - INTERVAL 7 DAY'))
def recent_window(f):
    return clean.recent(f.tracker, 7).select("user_id", "item_id", us("timestamp", "ts_us"), "action_type")


@query(sql('SELECT user_id, item_id, action_type FROM t, cut WHERE "timestamp" < cutoff'))
def before_cutoff(f):
    return f.tracker.crossJoin(F.broadcast(f.cut)).filter("timestamp < cutoff").select("user_id", "item_id", "action_type")


@query(sql("SELECT item_id, count(*) AS n FROM o JOIN (SELECT user_id, max(created_timestamp) AS c FROM o GROUP BY 1) USING (user_id) WHERE created_timestamp < c GROUP BY 1"))
def per_user_cutoff_pop(f):
    cutoffs = f.orders.groupBy("user_id").agg(F.max("created_timestamp").alias("cutoff"))
    return clean.before_user_cutoff(f.orders, cutoffs, "created_timestamp").groupBy("item_id").agg(F.count("*").alias("n"))


@query(sql("SELECT user_id, item_id, action_type, CAST(CASE action_type WHEN 'page_view' THEN 1 WHEN 'favorite' THEN 2 ELSE 3 END AS DOUBLE) AS simple, CAST(CASE action_type WHEN 'page_view' THEN 1 WHEN 'favorite' THEN 5 ELSE 10 END AS DOUBLE) AS scaled, CAST(CASE action_type WHEN 'page_view' THEN 2 WHEN 'favorite' THEN 5 ELSE 10 END AS DOUBLE) AS older FROM t"))
def action_weights(f):
    return f.tracker.select("user_id", "item_id", "action_type", S.lookup("action_type", S.SIMPLE_ACTION_WEIGHTS).alias("simple"), S.lookup("action_type", S.ACTION_WEIGHTS).alias("scaled"), S.lookup("action_type", S.OLDER_ACTION_WEIGHTS).alias("older"))


@query(sql("SELECT item_id, CAST(dense_rank() OVER (ORDER BY itemname) - 1 AS INTEGER) AS code FROM i"))
def factorized_names(f):
    return learning.factorized(f.items.select("item_id", "itemname"), "itemname").select("item_id", "code")


@query(sql("SELECT user_id, round(user_sum, 6) AS user_sum, CAST(0 AS DOUBLE) AS missing_feature FROM uf"))
def aligned_features(f):
    return S.aligned(f.user_features, ["user_sum", "missing_feature"], ["user_id"]).withColumn("user_sum", F.round("user_sum", 6))


@query(sql("SELECT item_id, CASE WHEN isfinite(x) THEN round(x, 6) ELSE 0 END AS x FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN CAST('inf' AS DOUBLE) ELSE catalogid / CAST(7 AS DOUBLE) END AS x FROM i) WHERE x IS NOT NULL UNION ALL SELECT item_id, CAST(0 AS DOUBLE) FROM i WHERE item_id % 3 = 0"))
def finite_features(f):
    x = F.when(F.col("item_id") % 3 == 1, float("inf")).when(F.col("item_id") % 3 == 2, F.col("catalogid") / 7.0)
    return f.items.select("item_id", x.alias("x")).select("item_id", F.round(S.finite("x"), 6).alias("x"))


@query(sql("SELECT epoch_us(cutoff) AS cutoff_us, (SELECT count(*) FROM tr) AS train, (SELECT count(*) FROM te) AS test FROM cut"))
def split_summary(f):
    return f.cut.select(us("cutoff", "cutoff_us")).crossJoin(f.train.agg(F.count("*").alias("train"))).crossJoin(f.test.agg(F.count("*").alias("test")))


@query(sql('SELECT user_id, item_id, round(weight, 6) AS weight, epoch_us("timestamp") AS ts_us, action_type FROM inter'))
def interactions(f):
    return f.interactions.select("user_id", "item_id", F.round("weight", 6).alias("weight"), us("timestamp", "ts_us"), "action_type")


@query(sql("SELECT user_id, item_id, epoch_us(\"timestamp\") AS ts_us, event_type, CAST(1 AS INTEGER) AS event_value FROM ue"))
def interactions_union(f):
    return f.events.select("user_id", "item_id", us("timestamp", "ts_us"), "event_type", "event_value")


# popularity and features


@query(sql("SELECT user_id, item_id, round(weight, 6) AS weight FROM uiw"))
def user_item_weights(f):
    return signals.user_item_weights(f.interactions).withColumn("weight", F.round("weight", 6))


@query(sql("SELECT item_id, round(n / CAST(max(n) OVER () AS DOUBLE), 6) AS score FROM (SELECT item_id, count(*) AS n FROM o, cut WHERE created_timestamp < cutoff GROUP BY 1)"))
def global_popularity(f):
    return signals.popularity(f.orders, f.cut).withColumn("score", F.round("score", 6))


@query(sql('SELECT item_id, count(*) AS score FROM ue WHERE "timestamp" >= (SELECT max("timestamp") FROM ue) - INTERVAL 14 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200'))
def windowed_popularity(f):
    return signals.windowed_popularity(f.events, 14, 200)


_COMBINED = "SELECT item_id, CAST(sum(w) AS BIGINT) AS score FROM (SELECT item_id, 3 AS w FROM {d} UNION ALL SELECT item_id, 1 FROM {v}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200"
_APPAREL = "ap AS (SELECT item_id FROM i WHERE catalogid IN (SELECT catalogid FROM x_categories WHERE list_has_any(ids, [7500, 17777, 7697]) AND len(ids) = 5))"


@query(sql(_COMBINED.format(d="d", v="vw")))
def combined_popularity(f):
    return signals.combined_popularity(f.delivered, f.views)


@query(sql(_COMBINED.format(d="(SELECT * FROM d WHERE item_id IN (SELECT item_id FROM ap))", v="(SELECT * FROM vw WHERE item_id IN (SELECT item_id FROM ap))"), _APPAREL))
def apparel_popularity(f):
    leaf = clean.items_under(f.items, f.categories, depth=5).select("item_id")
    return signals.combined_popularity(f.delivered.join(leaf, "item_id", "left_semi"), f.views.join(leaf, "item_id", "left_semi"))


@query(sql("SELECT item_id, score, pop_rank FROM pop"))
def order_count_rank(f):
    return f.popular.select("item_id", "score", "pop_rank")


def _rounded(df, prefix):
    return df.select(*[F.round(c, 6).alias(c) if c.rsplit("_", 1)[1] in ("sum", "mean", "max", "min") else F.col(c) for c in df.columns])


_FEATURES = "SELECT {k}_id, {k}_count, round({k}_sum, 6) AS {k}_sum, round({k}_mean, 6) AS {k}_mean, round({k}_max, 6) AS {k}_max, round({k}_min, 6) AS {k}_min, {k}_orders_count FROM {t}"


@query(sql(_FEATURES.format(k="user", t="uf")))
def user_features(f):
    return _rounded(f.user_features, "user")


@query(sql(_FEATURES.format(k="item", t="itf")))
def item_features(f):
    return _rounded(f.item_features, "item")


@query(sql("SELECT catalogid, count(*) AS cat_pop FROM o JOIN i USING (item_id) GROUP BY 1"))
def category_popularity(f):
    return signals.category_popularity(f.orders, f.items)


@query(sql("""SELECT user_id, item_id, coalesce(covisit_strength, 0) AS covisit_strength, round(coalesce(CAST(fclip_embed[1] AS DOUBLE), 0), 6) AS emb_0, action_type, epoch_us("timestamp") AS ts_us, CAST(isodow("timestamp") >= 6 AS INTEGER) AS is_weekend, CAST(hour("timestamp") AS INTEGER) AS hour,
  item_popularity, count(*) OVER (PARTITION BY coalesce(catalogid, -1)) AS category_popularity, count(*) OVER (PARTITION BY user_id) AS user_activity, round(avg(item_popularity) OVER (PARTITION BY user_id), 6) AS user_mean_popularity
  FROM (SELECT inter.*, catalogid, fclip_embed, count(*) OVER (PARTITION BY item_id) AS item_popularity FROM inter LEFT JOIN i USING (item_id)) LEFT JOIN cs USING (item_id) WHERE catalogid IS NOT NULL""", *_EXTRAS[:2]))
def rich_features(f):
    known = f.interactions.join(f.items.select("item_id"), "item_id", "left_semi")
    extras = item_extras(f.items, signals.covisit_strength(f.interactions.select("user_id", "item_id"))).select("item_id", "covisit_strength", F.round("emb_0", 6).alias("emb_0"))
    return signals.rich_features(known, f.items, extras)


@query(sql("SELECT user_id, item_id, count(*) AS user_item_count, CAST(floor((epoch_us((SELECT max(created_timestamp) FROM o)) - epoch_us(max(created_timestamp))) / CAST(86400000000 AS DOUBLE)) AS BIGINT) AS user_item_days_ago FROM o GROUP BY 1, 2"))
def user_item_history(f):
    return signals.user_item_history(f.orders)


@query(sql("SELECT user_id, count(*) AS user_activity, count(DISTINCT item_id) AS user_unique_items, CAST(floor((epoch_us((SELECT max(created_timestamp) FROM o)) - epoch_us(max(created_timestamp))) / CAST(86400000000 AS DOUBLE)) AS BIGINT) AS user_recency FROM o GROUP BY 1"))
def user_activity(f):
    return signals.user_activity(f.orders)


@query(sql("SELECT item_x, item_y, weight FROM cov"))
def covisitation(f):
    return f.pairs


@query(sql("SELECT item_id, CAST(sum(n) AS BIGINT) AS covisit_strength FROM (SELECT a, b, n, unnest([a, b]) AS item_id FROM (SELECT x.item_id AS a, y.item_id AS b, count(*) AS n FROM u x JOIN u y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2) WHERE n >= 5) GROUP BY 1", "u AS (SELECT DISTINCT user_id, item_id FROM ue)"))
def covisit_strength(f):
    return signals.covisit_strength(f.events)


@query(sql("SELECT item_id, nbr_id, strength, rank FROM cop"))
def copurchase(f):
    return f.neighbours.select("item_id", "nbr_id", "strength", "rank")


@query(sql("SELECT item_id, max(strength) AS strength FROM cop GROUP BY 1"))
def copurchase_strength(f):
    return f.neighbours.groupBy("item_id").agg(F.max("strength").alias("strength"))


@query(sql("SELECT c.user_id, c.item_id, coalesce(max(weight), 0) AS covis_max, CAST(coalesce(sum(weight), 0) AS BIGINT) AS covis_sum, count(weight) AS covis_count FROM c LEFT JOIN (SELECT user_id, item_id AS item_y FROM his) h USING (user_id) LEFT JOIN cov ON cov.item_x = c.item_id AND cov.item_y = h.item_y GROUP BY 1, 2", "c AS (SELECT user_id, item_id FROM rec)"))
def covis_features(f):
    return signals.covisit_features(f.recents.select("user_id", "item_id"), f.history, f.pairs)


@query(sql("""SELECT c.user_id, c.item_id, coalesce(p.n, 0) AS item_pop, coalesce(cp.n, 0) AS cat_pop, coalesce(ua.n, 0) AS user_activity, coalesce(ua.m, 0) AS user_unique_items, coalesce(ua.r, 999) AS user_recency, coalesce(ui.n, 0) AS user_item_count, coalesce(ui.r, 999) AS user_item_days_ago,
  coalesce(cv.hi, 0) AS covis_max, CAST(coalesce(cv.s, 0) AS BIGINT) AS covis_sum, coalesce(cv.n, 0) AS covis_count
  FROM rec c LEFT JOIN i USING (item_id) LEFT JOIN (SELECT item_id, count(*) AS n FROM o GROUP BY 1) p USING (item_id) LEFT JOIN (SELECT catalogid, count(*) AS n FROM o JOIN i USING (item_id) GROUP BY 1) cp ON cp.catalogid = i.catalogid
  LEFT JOIN (SELECT user_id, count(*) AS n, count(DISTINCT item_id) AS m, CAST(floor((epoch_us((SELECT max(created_timestamp) FROM o)) - epoch_us(max(created_timestamp))) / CAST(86400000000 AS DOUBLE)) AS BIGINT) AS r FROM o GROUP BY 1) ua ON ua.user_id = c.user_id
  LEFT JOIN (SELECT user_id, item_id, count(*) AS n, CAST(floor((epoch_us((SELECT max(created_timestamp) FROM o)) - epoch_us(max(created_timestamp))) / CAST(86400000000 AS DOUBLE)) AS BIGINT) AS r FROM o GROUP BY 1, 2) ui ON ui.user_id = c.user_id AND ui.item_id = c.item_id
  LEFT JOIN (SELECT rec.user_id, rec.item_id, max(weight) AS hi, sum(weight) AS s, count(*) AS n FROM rec JOIN (SELECT DISTINCT user_id, item_id AS item_y FROM o) h USING (user_id) JOIN cov ON cov.item_x = rec.item_id AND cov.item_y = h.item_y GROUP BY 1, 2) cv ON cv.user_id = c.user_id AND cv.item_id = c.item_id"""))
def pair_features(f):
    out = signals.pair_features(f.recents.select("user_id", "item_id"), f.orders, f.items, f.pairs)
    return out.select("user_id", "item_id", "item_pop", "cat_pop", "user_activity", "user_unique_items", "user_recency", "user_item_count", "user_item_days_ago", "covis_max", "covis_sum", "covis_count")


@query(sql("SELECT user_id, catalogid, round(sum(weight), 6) AS weight FROM uiw JOIN i USING (item_id) GROUP BY 1, 2"))
def user_category_pref(f):
    return signals.category_preferences(signals.user_item_weights(f.interactions), f.items).withColumn("weight", F.round("weight", 6))


@query(sql("SELECT round(100 * CAST(count(DISTINCT item_id) AS DOUBLE) / count(*), 6) AS uniqueness FROM rec"))
def uniqueness(f):
    return learning.uniqueness(f.recents)


@query(sql("SELECT quantile_cont(epoch_us(\"timestamp\"), 0.9) AS q_us FROM ue"))
def holdout_quantile(f):
    return reports.quantile_micros(f.events, "timestamp", 0.9)


@query(sql("SELECT user_id, epoch_us(created_timestamp) AS ts_us, array_to_string(list_sort(list(DISTINCT item_id)), ' ') AS basket FROM o GROUP BY 1, 2"))
def baskets(f):
    return f.orders.groupBy("user_id", us("created_timestamp", "ts_us")).agg(F.array_join(F.array_sort(F.collect_set("item_id")).cast("array<string>"), " ").alias("basket"))


# reports


@query(sql("SELECT last_status, count(*) AS n, round(100 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM x_orders), 4) AS percent FROM x_orders GROUP BY 1"))
def status_distribution(f):
    return reports.distribution(f.raw.orders, "last_status")


@query(sql("SELECT action_type, count(*) AS n, round(100 * CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM x_tracker), 4) AS percent FROM x_tracker GROUP BY 1"))
def action_distribution(f):
    return reports.distribution(f.raw.tracker, "action_type")


@query(sql("SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, min(epoch_us(created_timestamp)) AS first_us, max(epoch_us(created_timestamp)) AS last_us FROM x_orders"))
def profile(f):
    return reports.profile(f.raw.orders, "created_timestamp")


@query(sql("SELECT count(*) AS n, count(item_id) AS item_id, count(itemname) AS itemname, count(fclip_embed) AS fclip_embed, count(catalogid) AS catalogid FROM x_items"))
def null_profile(f):
    return reports.filled(f.raw.items, ["item_id", "itemname", "fclip_embed", "catalogid"])


@query(sql("SELECT catalogid, count(*) AS n FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def top_categories(f):
    return f.items.groupBy("catalogid").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "catalogid").limit(10)


@query(sql("SELECT strftime(created_timestamp, '%Y-%m-%d') AS day, count(*) AS n FROM x_orders GROUP BY 1"))
def daily_orders(f):
    return reports.per_day(f.raw.orders, "created_timestamp")


@query(sql("SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((n - lo) / ((hi - lo) / CAST(50 AS DOUBLE))), 49) END AS INTEGER) AS bin, count(*) AS keys FROM (SELECT n, min(n) OVER () AS lo, max(n) OVER () AS hi FROM (SELECT user_id, count(*) AS n FROM x_tracker GROUP BY 1)) GROUP BY 1"))
def activity_histogram(f):
    return reports.histogram(f.raw.tracker, "user_id", 50)


@query(sql("SELECT round(avg(n), 6) AS mean_n, max(n) AS max_n, CAST(bool_and(n = 5) AS INTEGER) AS all_k FROM (SELECT user_id, count(*) AS n FROM rec GROUP BY 1)"))
def rec_lengths(f):
    return reports.list_lengths(f.recents, 5)


@query(sql("SELECT count(*) AS entities, count(*) FILTER (abs(user_sum) > 0 OR user_orders_count > 0) AS with_features FROM uf"))
def feature_sanity(f):
    return reports.non_zero(f.user_features, ["user_sum", "user_orders_count"])


@query(sql('SELECT (SELECT max(epoch_us(created_timestamp)) FROM tr) AS train_last_us, (SELECT min(epoch_us(created_timestamp)) FROM te) AS test_first_us, CAST((SELECT max(created_timestamp) FROM tr) < (SELECT min(created_timestamp) FROM te) AS INTEGER) AS disjoint'))
def split_overlap(f):
    return reports.overlap(f.train, f.test, "created_timestamp")


# windows


@query(sql('SELECT user_id, item_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY "timestamp" DESC, item_id DESC, event_type DESC) AS INTEGER) AS pos FROM ue QUALIFY pos <= 10'))
def last_n_events(f):
    return signals.last_events(f.events, 10).select("user_id", "item_id", "event_type", "pos")


@query(sql("SELECT user_id, item_id, score, pos FROM rec"))
def recent_items(f):
    return f.recents.select("user_id", "item_id", "score", "pos")


_DECAYED = "dh AS (SELECT user_id, item_id, sum(CASE WHEN n > 20 AND back <= 20 THEN 0.5::DOUBLE ELSE 1 END) AS weight FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY created_timestamp DESC, item_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM d) GROUP BY 1, 2)"


@query(sql("SELECT user_id, item_id, weight FROM dh", _DECAYED))
def decayed_history(f):
    return signals.decayed_history(f.delivered)


@query(sql("SELECT user_id, item_id, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(weight, 6) DESC, item_id) AS INTEGER) AS rank FROM uiw QUALIFY rank <= 10"))
def topk_per_user(f):
    rounded = signals.user_item_weights(f.interactions).withColumn("weight", F.round("weight", 6))
    return signals.top_per_group(rounded, ["user_id"], [F.desc("weight"), F.asc("item_id")], 10)


@query(sql("SELECT user_id, CAST(k AS INTEGER) AS pos, item_id FROM (SELECT user_id, item_id, pos, count(*) OVER (PARTITION BY user_id) AS n FROM rec) JOIN (SELECT unnest(range(1, 21)) AS k) ON (k - 1) % n = pos - 1"))
def cyclic_fill(f):
    return C.repeat_to(f.recents.select("user_id", "item_id", "pos"), 20)


_FIRST_VIEWS = "fv AS (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY m, item_id) AS INTEGER) AS rank FROM (SELECT user_id, item_id, min(\"timestamp\") AS m FROM vw GROUP BY 1, 2) QUALIFY rank <= 50)"


@query(sql("SELECT user_id, item_id, rank FROM fv", _FIRST_VIEWS))
def first_views(f):
    first = f.views.groupBy("user_id", "item_id").agg(F.min("timestamp").alias("t"))
    return signals.top_per_group(first, ["user_id"], [F.asc("t"), F.asc("item_id")], 50).select("user_id", "item_id", "rank")


@query(sql("SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY later, score DESC, item_id) AS INTEGER) AS pos FROM (SELECT user_id, item_id, score, CASE WHEN n > 4 AND row_number() OVER (PARTITION BY user_id, coalesce(catalogid, -1) ORDER BY score DESC, item_id) > 2 THEN 1 ELSE 0 END AS later FROM (SELECT rec.*, catalogid, count(*) OVER (PARTITION BY user_id) AS n FROM rec JOIN i USING (item_id))) QUALIFY pos <= 4"))
def diversify(f):
    return C.diversify(f.scored, 4)


_HAS = "hs AS (SELECT DISTINCT user_id, item_id FROM ue)"


@query(sql("SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(pop_rank, 1000000000), item_id) AS INTEGER) AS pos FROM hs LEFT JOIN pop USING (item_id) QUALIFY pos <= 20", _HAS))
def popularity_truncate(f):
    return C.truncate_by_popularity(f.events.select("user_id", "item_id").distinct(), f.popular, 20)


# sets and joins


@query(sql("SELECT item_id FROM tr UNION SELECT item_id FROM t"))
def item_id_union(f):
    return f.train.select("item_id").union(f.tracker.select("item_id")).distinct()


@query(sql("SELECT a.user_id, min(b.user_id) AS other_id FROM (SELECT a.user_id, b.user_id AS other, count(*) AS n FROM hs a JOIN hs b ON a.item_id = b.item_id AND b.user_id < a.user_id GROUP BY 1, 2 HAVING count(*) >= 5) p JOIN (SELECT DISTINCT user_id FROM hs) a ON a.user_id = p.user_id JOIN (SELECT DISTINCT user_id FROM hs) b ON b.user_id = p.other GROUP BY 1", _HAS))
def similar_users(f):
    return C.similar_users(f.events)


@query(sql("SELECT item_id FROM i EXCEPT SELECT item_id FROM pop WHERE pop_rank < 500"))
def long_tail(f):
    return C.long_tail(f.items, f.popular)


_PAST = "SELECT tr.user_id, tr.item_id, last_status, count(inter.item_id) AS events, round(coalesce(sum(weight), 0), 6) AS weight FROM tr LEFT JOIN inter ON tr.user_id = inter.user_id AND tr.item_id = inter.item_id{on}{where} GROUP BY 1, 2, 3"


def _past(df):
    return df.groupBy("user_id", "item_id", "last_status").agg(F.count("event_ts").alias("events"), F.round(F.coalesce(F.sum("weight"), F.lit(0.0)), 6).alias("weight"))


@query(sql(_PAST.format(on=' AND inter."timestamp" < created_timestamp', where="")))
def safe_join(f):
    return _past(learning.past_join(f.train, f.interactions))


@query(sql(_PAST.format(on="", where=' WHERE inter."timestamp" < created_timestamp OR inter."timestamp" IS NULL')))
def safe_join_literal(f):
    return _past(learning.past_join(f.train, f.interactions, literal=True))


@query(sql(_PAST.format(on="", where="")))
def past_join_plain(f):
    joined = f.train.join(f.interactions.select("user_id", "item_id", "weight", F.col("timestamp").alias("event_ts")), ["user_id", "item_id"], "left")
    return _past(joined)


@query(sql("SELECT user_id, user_count FROM uf WHERE user_id IN (SELECT user_id FROM te)"))
def semi_features(f):
    return f.user_features.join(f.test.select("user_id"), "user_id", "left_semi").select("user_id", "user_count")


@query(sql("SELECT coalesce(a.item_id, b.item_id) AS item_id, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS events FROM (SELECT item_id, count(*) AS n FROM tr GROUP BY 1) a FULL JOIN (SELECT item_id, count(*) AS n FROM t GROUP BY 1) b ON a.item_id = b.item_id"))
def full_join_stats(f):
    a, b = f.train.groupBy("item_id").agg(F.count("*").alias("orders")), f.tracker.groupBy("item_id").agg(F.count("*").alias("events"))
    return a.join(b, "item_id", "full").na.fill(0, ["orders", "events"])


@query(sql("SELECT catalogid, item_id FROM cat"))
def category_expand(f):
    return signals.category_items(f.items, f.categories)


@query(sql("SELECT catalogid, item_id, nth FROM clist"))
def category_ranked(f):
    return f.category_list.select("catalogid", "item_id", "nth")


@query(sql("SELECT r.user_id, r.item_id, user_item.n FROM rec r JOIN (SELECT user_id, item_id, count(*) AS n FROM ue GROUP BY 1, 2) user_item ON r.user_id = user_item.user_id AND r.item_id = user_item.item_id"))
def pair_lookup(f):
    folder = sinks.scratch(f.spark, "pairs")
    table = folder.rpartition("/")[2].replace("-", "_")
    store_pairs(f.events.groupBy("user_id", "item_id").agg(F.count("*").alias("n")), table, folder, buckets=16)
    return look_up(f.spark, table, f.recents).select("user_id", "item_id", "n")


@query(sql("SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS BIGINT) AS idx FROM (SELECT DISTINCT user_id FROM inter)"))
def id_index(f):
    return learning.id_index(f.interactions, "user_id")


# embeddings

_VECTORS = """ve AS (SELECT item_id, list_transform(e, lambda x: x / n) AS v FROM (SELECT item_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT item_id, CAST(fclip_embed AS DOUBLE[]) AS e FROM i WHERE fclip_embed IS NOT NULL AND len(fclip_embed) > 0))),
seen AS (SELECT DISTINCT item_id FROM (SELECT user_id, item_id FROM his QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) <= 5)),
nb AS (SELECT q.item_id AS query_id, x.item_id, round(list_dot_product(q.v, x.v), 4) AS cosine, CAST(row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_dot_product(q.v, x.v), 4) DESC, x.item_id) AS INTEGER) AS rank
  FROM ve q JOIN ve x ON q.item_id IN (SELECT item_id FROM seen) AND x.item_id <> q.item_id QUALIFY rank <= 10)"""


def _last_five(f):
    return signals.top_per_group(f.history, ["user_id"], [F.desc("pos")], 5, "back")


def _near(f):
    return learning.embedding_neighbours(learning.embeddings(f.items), _last_five(f), 10)


@query(sql("SELECT query_id, item_id, cosine, rank FROM nb", _VECTORS))
def embedding_topk(f):
    return _near(f).select("query_id", "item_id", "cosine", "rank")


@query(sql("SELECT item_id, round(v[1], 5) AS e0, round(v[64], 5) AS e63 FROM ve", _VECTORS))
def embedding_index(f):
    v = learning.embeddings(f.items).select("item_id", S.normalized("vector").alias("vector"))
    return learning.embedding_columns(v, 64).select("item_id", F.round("emb_0", 5).alias("e0"), F.round("emb_63", 5).alias("e63"))


@query(sql("SELECT item_id, round(CAST(fclip_embed[1] AS DOUBLE) + 1, 5) AS first_sum, round(list_sum(list_transform(CAST(fclip_embed AS DOUBLE[]), lambda x: x + 1)) , 4) AS total FROM i WHERE fclip_embed IS NOT NULL"))
def vector_add(f):
    ones = S.resized(F.array_repeat(F.lit(1.0), 64), 64)
    total = S.added(S.resized(F.col("vector"), 64), ones)
    return learning.embeddings(f.items).select("item_id", F.round(F.get(total, F.lit(0)), 5).alias("first_sum"), F.round(F.aggregate(total, F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) + 0.5 AS first, CAST(3 AS INTEGER) AS n FROM part")
def parsed_vectors(f):
    """Vectors written as text in either of two ways."""
    size, even = F.col("p_size").cast("string"), F.col("p_partkey") % 2 == 0
    text = F.when(even, F.concat(F.lit("["), size, F.lit(".5, 2.0, 3.0]"))).otherwise(F.concat(F.lit("["), size, F.lit(".5 2.0  3.0]")))
    return f.raw.table("part").select(F.col("p_partkey").cast("long").alias("id"), text.alias("text")).select("id", S.parse_vector("text").alias("v")).select("id", F.get("v", F.lit(0)).cast("double").alias("first"), F.size("v").alias("n"))


_KIND = "event_id % 7"
_K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query(f"""SELECT CAST(event_id AS BIGINT) AS event_id, CASE WHEN {_KIND} IN (0, 1, 2, 3, 4) THEN {_K} ELSE 0 END AS k,
  CASE {_KIND} WHEN 1 THEN 2.5 WHEN 2 THEN {_K} WHEN 3 THEN 0.5 ELSE 0 END AS z FROM events""")
def entry_vectors(f):
    """Feature entries of all kinds (records, lists, numbers, text, lists of a record, others) as one kind of vector."""
    k, kind = F.get_json_object("props", "$.k"), F.col("event_id") % 7
    text = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("["), k, F.lit(", 2.5, null]"))).when(kind == 2, k).when(kind == 3, F.concat(F.lit('"['), k, F.lit(' 0.5]"')))
    text = text.when(kind == 4, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(kind == 5, F.lit("true"))
    v = S.entry_vector(F.col("entry"), ["k", "z"])
    rows = f.raw.table("events").select("event_id", F.try_parse_json(text).alias("entry")).select(F.col("event_id").cast("long").alias("event_id"), v.alias("v"))
    return rows.select("event_id", F.col("v")[0].alias("k"), F.col("v")[1].alias("z"))


@query(sql("SELECT item_id, round(list_sum(list_transform(v[1:4], lambda x: x)), 5) AS first_four FROM ve", _VECTORS))
def prefixed_columns(f):
    """A family of columns, found by its prefix, in the order of its numbers."""
    wide = learning.embedding_columns(learning.embeddings(f.items).select("item_id", S.normalized("vector").alias("vector")), 12)
    first = S.prefixed(wide.columns, "emb_")[:4]
    return wide.select("item_id", F.round(sum((F.col(c) for c in first[1:]), F.col(first[0])), 5).alias("first_four"))


@query()
def embedding_probed(f):
    """What a probed search finds of the exact neighbours, and how many rows either search compares; the probes are set on a sample of the queries."""
    vectors = learning.embeddings(f.items)
    index = VectorIndex.build(vectors, sinks.scratch(f.spark, "vectors"))
    asked = vectors.join(_last_five(f).select("item_id").distinct(), "item_id", "left_semi")
    probes = index.probes_for(asked, 10)
    # stored one after the other: the queries and vectors that moved for one search are gone before the next one
    found = {n: sinks.stage(index.found(asked, 10, probes, exact=e), f"found-{n}") for n, e in (("exact", True), ("probed", False))}
    best = {n: signals.top_per_group(df, ["query_id"], [F.desc("cosine"), F.asc("item_id")], 10).select("query_id", "item_id") for n, df in found.items()}
    both = best["exact"].join(best["probed"].withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left").agg(F.count("*").alias("neighbours"), F.count("hit").alias("hits"))
    counts = [df.agg(F.sum("compared").alias(f"compared_{n}")) for n, df in found.items()]
    return both.crossJoin(counts[0]).crossJoin(counts[1]).withColumn("probes", F.lit(probes)).withColumn("recall", F.round(F.col("hits") / F.col("neighbours"), 4))


# candidates

_RECENT = "re AS (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY \"timestamp\" DESC, item_id DESC, event_type DESC) AS INTEGER) AS a FROM ue WHERE user_id IN (SELECT user_id FROM usr) QUALIFY a <= 30)"
_RECENT_FULL = (_RECENT, first_seen("re", "a", "rl", 100), filled("rl", 100, "rf"))


@query(sql("SELECT user_id, item_id, pos FROM rf", *_RECENT_FULL))
def recent_candidates(f):
    return C.recent_candidates(f.events, f.users, f.popular, 30, K)


_COVIS = "cn AS (SELECT h.user_id, n.item_y AS item_id, h.pos AS p1, n.nbr AS p2 FROM his h JOIN (SELECT item_x, item_y, row_number() OVER (PARTITION BY item_x ORDER BY weight DESC, item_y) AS nbr FROM cov QUALIFY nbr <= 10) n ON n.item_x = h.item_id WHERE h.user_id IN (SELECT user_id FROM usr) AND NOT EXISTS (SELECT 1 FROM his g WHERE g.user_id = h.user_id AND g.item_id = n.item_y))"
_COVIS_FULL = (_COVIS, first_seen("cn", "p1, p2", "cl", 100), filled("cl", 100, "cf"))


@query(sql("SELECT user_id, item_id, pos FROM cf", *_COVIS_FULL))
def covis_candidates(f):
    return C.covis_candidates(f.history, f.pairs, f.users, f.popular, 10, K)


_ANN = (_VECTORS, "an AS (SELECT h.user_id, nb.item_id, -h.pos AS p1, nb.rank AS p2 FROM (SELECT * FROM his QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY pos DESC) <= 5) h JOIN nb ON nb.query_id = h.item_id WHERE NOT EXISTS (SELECT 1 FROM his g WHERE g.user_id = h.user_id AND g.item_id = nb.item_id))", first_seen("an", "p1, p2", "al", 100))


def _ann(f):
    met = _last_five(f).join(_near(f).select(F.col("query_id").alias("item_id"), F.col("item_id").alias("near_id"), "rank"), "item_id")
    new = met.select("user_id", F.col("near_id").alias("item_id"), (-F.col("pos")).alias("p1"), F.col("rank").alias("p2")).join(f.history.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return C.first_occurrences(new, ["p1", "p2"], K)


@query(sql("SELECT user_id, item_id, pos FROM al", *_ANN))
def ann_candidates(f):
    return _ann(f).select("user_id", "item_id", "pos")


@query(sql("SELECT user_id, item_id, pos FROM mf", *_RECENT_FULL, *_COVIS_FULL, *_ANN, "ms AS (SELECT user_id, item_id, 0 AS p1, pos AS p2 FROM rl UNION ALL SELECT user_id, item_id, 1, pos FROM cl UNION ALL SELECT user_id, item_id, 2, pos FROM al WHERE user_id IN (SELECT user_id FROM usr))", first_seen("ms", "p1, p2", "ml", 100), filled("ml", 100, "mf")))
def merged_candidates(f):
    return C.merge_lists([C.recent_lists(f.events, f.users, 30, K), C.covis_lists(f.history, f.pairs, f.users, 10, K), _ann(f).join(f.users, "user_id", "left_semi")], f.users, f.popular, K)


_COLD_USERS = "cu AS (SELECT user_id FROM usr WHERE user_id NOT IN (SELECT user_id FROM rec GROUP BY 1 HAVING count(*) >= 3))"
_COLD = """np AS (SELECT count(*) AS n FROM pop), cc AS (SELECT user_id, s, l1, least(240 - l1, n) AS l2, greatest(240 - l1 - least(240 - l1, n), 0) AS l3 FROM (SELECT user_id, n, (user_id % 50) * 120 AS s, least(240, greatest(n - (user_id % 50) * 120, 0)) AS l1 FROM cu, np)),
cold AS (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY a) AS INTEGER) AS pos FROM (
  SELECT user_id, item_id, pop_rank - s AS a FROM cc JOIN pop ON pop_rank >= s AND pop_rank < s + l1
  UNION ALL SELECT user_id, item_id, l1 + pop_rank FROM cc JOIN pop ON pop_rank < l2
  UNION ALL SELECT user_id, item_id, l1 + l2 + pop_rank - 500 FROM cc JOIN pop ON pop_rank >= 500 AND pop_rank < 500 + l3) QUALIFY pos <= 300)"""


def _cold_users(f):
    warm = f.recents.groupBy("user_id").count().filter("count >= 3").select("user_id")
    return f.users.join(warm, "user_id", "left_anti")


@query(sql("SELECT user_id, item_id, pos FROM cold", _COLD_USERS, _COLD))
def cold_candidates(f):
    return C.cold_candidates(_cold_users(f), f.popular, f.n_popular)


_WARM = (
    _COLD_USERS,
    "wu AS (SELECT user_id FROM usr WHERE user_id NOT IN (SELECT user_id FROM cu))",
    "wo AS (SELECT rec.* FROM rec JOIN wu USING (user_id) WHERE item_id IN (SELECT item_id FROM i))",
    """wa AS (SELECT user_id, item_id, 0 AS prio, pos AS p1, 0 AS p2 FROM wo WHERE pos <= 30
  UNION ALL SELECT user_id, nbr_id, 1, pos, rank FROM wo JOIN cop ON cop.item_id = wo.item_id AND rank <= 8 WHERE pos <= 15 AND nbr_id IN (SELECT item_id FROM i)
  UNION ALL SELECT user_id, clist.item_id, 2, p1, nth FROM (SELECT user_id, catalogid, min(pos) AS p1 FROM wo JOIN i USING (item_id) WHERE pos <= 20 AND catalogid IS NOT NULL AND catalogid <> 0 GROUP BY 1, 2) JOIN clist USING (catalogid) WHERE nth <= 10)""",
    first_seen("wa", "prio, p1, p2", "wf", 300),
    "wn AS (SELECT user_id, CAST(300 - count(wf.item_id) AS INTEGER) AS needed FROM wu LEFT JOIN wf USING (user_id) GROUP BY 1)",
    """wm AS (SELECT user_id, item_id, -1 AS prio, pos AS p1, 0 AS p2 FROM wf
  UNION ALL SELECT user_id, item_id, 3, pop_rank - 50 - user_id % 100, 0 FROM wn JOIN pop ON pop_rank >= 50 + user_id % 100 AND pop_rank < 50 + user_id % 100 + needed // 2 WHERE needed > 0
  UNION ALL SELECT user_id, item_id, 4, pop_rank - 200 - user_id % 150, 0 FROM wn JOIN pop ON pop_rank >= 200 + user_id % 150 AND pop_rank < 200 + user_id % 150 + needed WHERE needed > 0)""",
    first_seen("wm", "prio, p1, p2", "warm", 300),
)


def _warm(f):
    return C.unlisted(_warm_listed(f))


def _warm_listed(f):
    users = f.users.join(f.recents.groupBy("user_id").count().filter("count >= 3"), "user_id", "left_semi")
    return C.warm_listed(users, f.recents, f.neighbours, f.items.select("item_id", "catalogid"), f.category_head, f.popular)


@query(sql("SELECT user_id, item_id, pos FROM warm", *_WARM))
def warm_candidates(f):
    return _warm(f)


@query(sql("SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(pop_rank, 1000000000), item_id) AS INTEGER) AS pos FROM lg LEFT JOIN pop USING (item_id) QUALIFY pos <= 300", "lh AS (SELECT rec.* FROM rec JOIN usr USING (user_id))", """lg AS (SELECT user_id, item_id FROM lh WHERE pos <= 30 UNION SELECT user_id, nbr_id FROM lh JOIN cop ON cop.item_id = lh.item_id AND rank <= 15 WHERE pos <= 10
  UNION SELECT user_id, clist.item_id FROM lh JOIN i USING (item_id) JOIN clist ON clist.catalogid = i.catalogid AND nth <= 15 WHERE pos <= 5 UNION SELECT user_id, item_id FROM usr JOIN pop ON pop_rank < 5)"""))
def legacy_candidates(f):
    return C.legacy_candidates(f.recents, f.neighbours, f.items.select("item_id", "catalogid"), f.category_head, f.popular, f.users)


_RELATED = "rel AS (SELECT a.item_id, b.item_id AS related_id, CAST(row_number() OVER (PARTITION BY a.item_id ORDER BY b.item_id) AS INTEGER) AS rank FROM i a JOIN i b ON a.catalogid = b.catalogid AND a.item_id <> b.item_id QUALIFY rank <= 3)"


@query(sql("SELECT item_id, related_id, rank FROM rel", _RELATED))
def related_items(f):
    return C.related_items(f.items)


_HEURISTIC = (
    _DECAYED, _RELATED,
    "hw AS (SELECT user_id, item_id, sum(w) AS weight FROM (SELECT user_id, item_id, weight AS w FROM dh UNION ALL SELECT user_id, item_id, CAST(CASE action_type WHEN 'page_view' THEN 1 WHEN 'favorite' THEN 2 ELSE 3 END AS DOUBLE) FROM t) WHERE user_id IN (SELECT user_id FROM usr) GROUP BY 1, 2)",
    "ho AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, item_id) AS a FROM hw QUALIFY a <= 100)",
    "ha AS (SELECT user_id, item_id, 0 AS prio, a AS p1, 0 AS p2 FROM ho UNION ALL SELECT user_id, related_id, 1, a, rank FROM ho JOIN rel USING (item_id))",
    first_seen("ha", "prio, p1, p2", "hl", 100), filled("hl", 100, "hf"),
)


@query(sql("SELECT user_id, item_id, pos FROM hf", *_HEURISTIC))
def heuristic_recs(f):
    seen = f.tracker.select("user_id", "item_id", S.lookup("action_type", S.SIMPLE_ACTION_WEIGHTS).alias("weight"))
    weights = signals.decayed_history(f.delivered).unionByName(seen).repartition("user_id").groupBy("user_id", "item_id").agg(F.sum("weight").alias("weight"))
    return C.heuristic_recs(weights, C.related_items(f.items), f.users, f.popular)


_PREFERRED = "pr AS (SELECT user_id, item_id FROM d UNION SELECT user_id, item_id FROM fv)"


@query(sql("SELECT user_id, item_id FROM pr", _FIRST_VIEWS, _PREFERRED))
def preferences(f):
    return C.preferences(f.delivered, f.views)


_TOP200 = f"top AS (SELECT item_id, CAST(row_number() OVER (ORDER BY score DESC, item_id) - 1 AS INTEGER) AS pop_rank FROM ({_COMBINED.format(d='d', v='vw')}))"
_BASELINE = "bl AS (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY pop_rank) AS INTEGER) AS rank FROM usr, top WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.user_id = usr.user_id AND pr.item_id = top.item_id) QUALIFY rank <= {k})"


def _baseline(f, k):
    top = signals.top_items(signals.combined_popularity(f.delivered, f.views), 200)
    return C.unseen_popular(f.users, top, C.preferences(f.delivered, f.views), k)


@query(sql("SELECT user_id, item_id, rank FROM bl", _FIRST_VIEWS, _PREFERRED, _TOP200, _BASELINE.format(k=50)))
def baseline_recs(f):
    return _baseline(f, 50)


@query(sql("SELECT user_id, CAST(k AS INTEGER) AS pos, item_id FROM (SELECT user_id, item_id, rank, count(*) OVER (PARTITION BY user_id) AS n FROM bl) JOIN (SELECT unnest(range(1, 101)) AS k) ON (k - 1) % n = rank - 1", _FIRST_VIEWS, _PREFERRED, _TOP200, _BASELINE.format(k=60)))
def popular_100(f):
    return C.repeat_to(_baseline(f, 60).withColumnRenamed("rank", "pos"), K)


@query(sql("SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY (item_id * 7919 + (user_id % 1000) * 104729) % 1000003, item_id) AS INTEGER) AS rank FROM usr, (SELECT item_id FROM i EXCEPT SELECT item_id FROM pop WHERE pop_rank < 500) QUALIFY rank <= 100"))
def exploration(f):
    return C.spread_sample(f.users, C.long_tail(f.items, f.popular), K)


@query(sql("SELECT user_id, item_id, CAST(pop_rank - (user_id % 20) * (n // 20) + 1 AS INTEGER) AS pos FROM usr, (SELECT count(*) AS n FROM pop), pop WHERE pop_rank >= (user_id % 20) * (n // 20) AND pop_rank < (user_id % 20) * (n // 20) + 100"))
def segment_popular(f):
    return C.segment_popular(f.users, f.popular, f.n_popular)


@query(sql("SELECT user_id, item_id, pos FROM bf", "bk AS (SELECT user_id, item_id, pos FROM rec WHERE user_id IN (SELECT user_id FROM usr))", filled("bk", 100, "bf")))
def backfill(f):
    return C.fill_up(f.recents.join(f.users, "user_id", "left_semi").select("user_id", "item_id", "pos"), f.users, f.popular, K)


_FINAL = (
    "fb AS (SELECT user_id, item_id, pos FROM rec WHERE user_id IN (SELECT user_id FROM usr))",
    "fh AS (SELECT user_id, count(fb.item_id) AS have FROM usr LEFT JOIN fb USING (user_id) GROUP BY 1)",
    "fa AS (SELECT user_id, item_id, CAST(have + row_number() OVER (PARTITION BY user_id ORDER BY pop_rank) AS INTEGER) AS pos FROM fh JOIN pop ON pop_rank >= (user_id % 100) * 2 AND pop_rank < (user_id % 100) * 2 + 100 WHERE have < 100 AND NOT EXISTS (SELECT 1 FROM fb WHERE fb.user_id = fh.user_id AND fb.item_id = pop.item_id) QUALIFY pos <= 100)",
    "fz AS (SELECT * FROM fb UNION ALL SELECT * FROM fa)",
    "fs AS (SELECT user_id, count(fz.item_id) AS have FROM usr LEFT JOIN fz USING (user_id) GROUP BY 1)",
    "fin AS (SELECT * FROM fz UNION ALL SELECT user_id, item_id, CAST(have + pop_rank + 1 AS INTEGER) FROM fs JOIN pop ON pop_rank < 100 - have)",
)


def _final(f):
    return C.final_ranking(f.scored.join(f.users, "user_id", "left_semi"), f.users, f.popular, K)


@query(sql("SELECT user_id, item_id, pos FROM fin", *_FINAL))
def final_ranking(f):
    return _final(f)


@query(sql("SELECT user_id, array_to_string(list(item_id ORDER BY pos, item_id), ' ') AS items FROM fin GROUP BY 1", *_FINAL))
def submission(f):
    return sinks.submission(_final(f))


@query(sql("SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY (item_id * 7919 + (user_id % 1000) * 104729) % 1000003, item_id) AS INTEGER) AS rank FROM (SELECT DISTINCT user_id FROM te) u, i WHERE NOT EXISTS (SELECT 1 FROM te WHERE te.user_id = u.user_id AND te.item_id = i.item_id) QUALIFY rank <= 10"))
def negatives(f):
    return C.negatives(f.test.select("user_id", "item_id"), f.items, 10)


# training frames and metrics


@query(sql("SELECT rec.user_id, rec.item_id, CAST(EXISTS (SELECT 1 FROM te WHERE te.user_id = rec.user_id AND te.item_id = rec.item_id) AS INTEGER) AS label FROM rec"))
def labels(f):
    return learning.labels_of(f.recents.select("user_id", "item_id"), f.test)


@query(sql("""SELECT p.user_id, p.item_id, last_status, target, past_events, round(past_weight, 6) AS past_weight, coalesce(user_count, 0) AS user_count, round(coalesce(user_mean, 0), 6) AS user_mean, coalesce(item_count, 0) AS item_count, round(coalesce(item_mean, 0), 6) AS item_mean
  FROM (SELECT tr.user_id, tr.item_id, last_status, target, count(inter.item_id) AS past_events, coalesce(sum(weight), 0) AS past_weight FROM tr LEFT JOIN inter ON tr.user_id = inter.user_id AND tr.item_id = inter.item_id AND inter."timestamp" < created_timestamp GROUP BY ALL) p
  LEFT JOIN uf ON uf.user_id = p.user_id LEFT JOIN itf ON itf.item_id = p.item_id"""))
def train_set(f):
    out = learning.training_set(f.train, f.interactions, f.user_features, f.item_features)
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("user_id", "item_id", "last_status", "target", "past_events", r("past_weight"), "user_count", r("user_mean"), "item_count", r("item_mean"))


@query(sql("SELECT user_id, item_id, target, CAST((user_id * 7919) % 100 < 80 AS INTEGER) AS is_train FROM o"))
def hash_split(f):
    return clean.hash_split(f.orders.select("user_id", "item_id", "target"))


@query(sql('SELECT count(*) AS leaks FROM tr JOIN inter ON tr.user_id = inter.user_id AND tr.item_id = inter.item_id WHERE inter."timestamp" > created_timestamp'))
def leakage(f):
    joined = f.train.join(f.interactions.select("user_id", "item_id", F.col("timestamp").alias("event_ts")), ["user_id", "item_id"])
    return learning.leaks(joined)


@query(sql("""SELECT r.user_id, r.item_id, coalesce(user_count, 0) AS user_count, coalesce(item_count, 0) AS item_count, round(coalesce(w / tot, 0), 6) AS cat_match_score
  FROM rec r LEFT JOIN uf ON uf.user_id = r.user_id LEFT JOIN itf ON itf.item_id = r.item_id LEFT JOIN i ON i.item_id = r.item_id
  LEFT JOIN (SELECT user_id, catalogid, sum(weight) AS w, sum(sum(weight)) OVER (PARTITION BY user_id) AS tot FROM uiw JOIN i USING (item_id) GROUP BY 1, 2) p ON p.user_id = r.user_id AND p.catalogid = i.catalogid"""))
def scoring_frame(f):
    prefs = signals.category_preferences(signals.user_item_weights(f.interactions), f.items)
    out = learning.scoring_frame(f.recents.select("user_id", "item_id"), f.user_features, f.item_features, f.items, prefs)
    return out.select("user_id", "item_id", "user_count", "item_count", F.round("cat_match_score", 6).alias("cat_match_score"))


@query(sql("SELECT user_id, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM (SELECT user_id, list_sum(list_transform(range(1, least(count(*), 100) + 1), lambda x: 1 / log2(x + 1))) AS ideal FROM (SELECT DISTINCT user_id, item_id FROM te) GROUP BY 1) LEFT JOIN (SELECT fin.user_id, sum(1 / log2(pos + 1)) AS dcg FROM fin JOIN (SELECT DISTINCT user_id, item_id FROM te) te ON te.user_id = fin.user_id AND te.item_id = fin.item_id GROUP BY 1) USING (user_id)", *_FINAL))
def ndcg_list(f):
    return learning.ndcg_lists(_final(f), f.test)


_LABELLED = "lb AS (SELECT user_id, item_id, score, CAST(EXISTS (SELECT 1 FROM te WHERE te.user_id = rec.user_id AND te.item_id = rec.item_id) AS INTEGER) AS label, pos FROM rec)"


def _labelled(f):
    return learning.labels_of(f.recents, f.test)


_NDCG = "SELECT round(coalesce(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 0), 6) AS ndcg, count(*) AS users FROM (SELECT user_id, sum(CASE WHEN pos <= 3 THEN label / log2(pos + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ia <= 3 THEN label / log2(ia + 1) ELSE 0 END) AS idcg, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY label DESC, pos) AS ia FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM lb){w}) GROUP BY 1){f}"


@query(sql(_NDCG.format(w="", f=""), _LABELLED))
def ndcg_grouped(f):
    return learning.ndcg_grouped(_labelled(f), 3)


@query(sql(_NDCG.format(w=" WHERE pos <= 3", f=" WHERE n > 1 AND idcg > 0"), _LABELLED))
def ndcg_fast(f):
    return learning.ndcg_grouped(_labelled(f), 3, fast=True)


# inference: candidates, features, model, ranking, submission

_CAND = "cand AS (SELECT user_id, item_id, min(pos) AS pos FROM (SELECT user_id, item_id, pos FROM warm UNION ALL SELECT user_id, item_id, pos FROM cold) GROUP BY 1, 2)"


def _candidates(f):
    return C.warm_or_cold(f.by_user(f.users), _warm_listed(f), C.cold_classes(f.popular, f.n_popular))


def _often(f):
    """The items of the bounded lists that candidates come from: all but a user's own recent items."""
    heads = [f.popular.filter(F.col("pop_rank") < C.cold_reach()), f.neighbours.select(F.col("nbr_id").alias("item_id")), f.category_head]
    return tables.concat([h.select("item_id") for h in heads]).distinct()


def _recommender(f):
    past = f.interactions.groupBy("user_id", "item_id").agg(F.sum("weight").alias("past_weight"), F.count("*").alias("past_events"))
    # counted once: the training frame, the rows to score and the candidates all read it
    strength = sinks.stage(signals.covisit_strength(f.interactions.select("user_id", "item_id")), "strength")
    return Recommender(f.user_features, f.item_features, past, f.popular.select("item_id", "pop_rank"), item_extras(f.items, strength), category_shares(signals.user_item_weights(f.interactions), f.items), _often(f))


_EXTRA_COLUMNS = "coalesce(covisit_strength, 0) AS covisit_strength, round(coalesce(share, 0), 6) AS cat_match_score, round(coalesce(CAST(fclip_embed[1] AS DOUBLE), 0), 6) AS emb_0"
_EXTRA_JOINS = "LEFT JOIN i ON i.item_id = {t}.item_id LEFT JOIN cs ON cs.item_id = {t}.item_id LEFT JOIN sh ON sh.user_id = {t}.user_id AND sh.catalogid = i.catalogid"


@query(sql("""SELECT cand.user_id, cand.item_id, pos, round(coalesce(p.w, 0), 6) AS past_weight, coalesce(p.n, 0) AS past_events, coalesce(user_count, 0) AS user_count, round(coalesce(user_mean, 0), 6) AS user_mean,
  coalesce(item_count, 0) AS item_count, round(coalesce(item_mean, 0), 6) AS item_mean, coalesce(item_orders_count, 0) AS item_orders_count, """ + _EXTRA_COLUMNS + """
  FROM cand LEFT JOIN (SELECT user_id, item_id, sum(weight) AS w, count(*) AS n FROM inter GROUP BY 1, 2) p ON p.user_id = cand.user_id AND p.item_id = cand.item_id
  LEFT JOIN uf ON uf.user_id = cand.user_id LEFT JOIN itf ON itf.item_id = cand.item_id """ + _EXTRA_JOINS.format(t="cand"), *_WARM, _COLD, _CAND, *_EXTRAS))
def inference_frame(f):
    out = _recommender(f).frame(_candidates(f))
    r = lambda c: F.round(c, 6).alias(c)
    return out.select("user_id", "item_id", "pos", r("past_weight"), "past_events", "user_count", r("user_mean"), "item_count", r("item_mean"), "item_orders_count", "covisit_strength", r("cat_match_score"), r("emb_0"))


#: What the queries train: fewer rounds than the defaults.
ROUNDS, DEPTH = 12, 4


def _ranker(f):
    """The recommender with a model that orders, and the rows that it learnt from: they are made once."""
    own = _recommender(f)
    rows, _ = own.training_rows(f.train, f.interactions)
    return replace(own, model=own.fit_rows(rows, Booster(rounds=ROUNDS, depth=DEPTH, patience=10)).ensemble), rows


@query()
def inference(f):
    """From the tables to the submission; its candidates and features are those of inference_frame, its model is trained here to order."""
    model = _recommender(f).train(f.train, f.interactions, rounds=ROUNDS, depth=DEPTH)
    return sinks.submission(model.recommend(_candidates(f), f.users, K))


@query()
def validation_ndcg(f):
    """The trained model on the users that validate."""
    model, rows = _ranker(f)
    return model.evaluate(rows.filter("validates"))


@query()
def lambdarank_rounds(f):
    """NDCG@100 of the users that validate after each round, and the round that is kept."""
    return _recommender(f).fit(f.train, f.interactions, Booster(rounds=ROUNDS, depth=DEPTH)).rounds(f.spark)


@query()
def lambdarank_scores(f):
    model, rows = _ranker(f)
    return model.score(rows).select("user_id", "item_id", "last_status", "target", "score")


@query()
def warm_start_rounds(f):
    """Learns from the older half of the orders and goes on with the newer half: (round, ndcg, chosen) of the second run."""
    own, cut = _recommender(f), clean.cutoff(f.train, 0.5)
    older, newer = clean.split(f.train, cut)
    first = own.fit(older, f.interactions, Booster(rounds=ROUNDS // 2, depth=DEPTH)).ensemble
    return own.fit(newer, f.interactions, Booster(rounds=ROUNDS // 2, depth=DEPTH), start=first).rounds(f.spark)


@query(sql("""SELECT tr.user_id, tr.item_id, last_status, target, count(inter.item_id) AS past_events, coalesce(round(sum(weight), 6), 0) AS past_weight FROM tr LEFT JOIN inter ON tr.user_id = inter.user_id AND tr.item_id = inter.item_id GROUP BY ALL"""))
def train_set_by_user(f):
    """The training frame for splits by user: interactions of any time count."""
    out = _recommender(f).training_frame(f.train, f.interactions, before=False)
    return out.select("user_id", "item_id", "last_status", "target", "past_events", F.round("past_weight", 6).alias("past_weight"))


@query()
def incremental_factors(f):
    """Factors learnt in two batches of interactions, half of the users each, at the full rank and with all iterations: scores of recent items."""
    weights = f.interactions.withColumn("half", F.pmod(F.xxhash64("user_id"), F.lit(2)))
    store = FactorStore(f.spark, sinks.scratch(f.spark, "factors"))
    for number in (0, 1):
        store.update(weights.filter(F.col("half") == number).select("user_id", "item_id", "weight"), number)
    return store.scores(f.recents)


_EXPLORED = (
    "ex AS (SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY (item_id * 7919 + (user_id % 1000) * 104729) % 1000003, item_id) AS INTEGER) AS rank FROM usr, (SELECT item_id FROM i EXCEPT SELECT item_id FROM pop WHERE pop_rank < 500) QUALIFY rank <= 100)",
    "xs AS (SELECT user_id, item_id, CASE WHEN pos <= 90 THEN 0 ELSE 2 END AS prio, pos AS p1 FROM fin UNION ALL SELECT user_id, item_id, 1, rank FROM ex WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM fin WHERE fin.user_id = ex.user_id AND fin.item_id = ex.item_id))",
    first_seen("xs", "prio, p1", "xl", 100),
)


@query(sql("SELECT user_id, item_id, pos FROM xl", *_FINAL, *_EXPLORED))
def explored(f):
    return C.explore(_final(f), C.spread_sample(f.users, C.long_tail(f.items, f.popular), K), K)


_SAME = "sl AS (SELECT user_id, list_sort(list(item_id)) AS items FROM rec GROUP BY 1 HAVING count(*) = 5), sm AS (SELECT user_id, min(user_id) OVER (PARTITION BY items) AS other_id FROM sl), sim AS (SELECT user_id, other_id FROM sm WHERE other_id < user_id)"


@query(sql("SELECT user_id, item_id, pos FROM fin WHERE user_id NOT IN (SELECT user_id FROM sim) UNION ALL SELECT sim.user_id, item_id, pos FROM sim JOIN fin ON fin.user_id = sim.other_id", *_FINAL, _SAME))
def reused_lists(f):
    return C.reuse_lists(_final(f), C.same_recents(f.recents))


@query(sql("SELECT u.idx AS user_idx, v.idx AS item_idx, round(sum(weight), 6) AS weight FROM inter JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM (SELECT DISTINCT user_id FROM inter)) u USING (user_id) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM inter)) v USING (item_id) GROUP BY 1, 2"))
def indexed_weights(f):
    weights = signals.user_item_weights(f.interactions)
    out = learning.indexed(weights, learning.id_index(weights, "user_id"), learning.id_index(weights, "item_id"))
    return out.select(F.col("user_id").cast("long").alias("user_idx"), F.col("item_id").cast("long").alias("item_idx"), F.round("weight", 6).alias("weight"))


@query(sql("SELECT user_id, item_id, coalesce(epoch_us(TRY_CAST(CASE WHEN item_id % 7 = 0 THEN 'soon' ELSE strftime(created_timestamp, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)), -1) AS ts_us FROM x_orders"))
def coerced_times(f):
    text = F.when(F.col("item_id") % 7 == 0, F.lit("soon")).otherwise(F.date_format("created_timestamp", "yyyy-MM-dd HH:mm:ss"))
    return f.raw.orders.select("user_id", "item_id", text.alias("text")).select("user_id", "item_id", F.coalesce(F.unix_micros(S.parse_time("text")), F.lit(-1)).alias("ts_us"))


@query(sql("SELECT target, count(*) AS rows, count(*) FILTER (WHERE covisit_strength IS NULL OR share IS NULL OR fclip_embed IS NULL OR len(fclip_embed) = 0) AS lacking FROM tr " + _EXTRA_JOINS.format(t="tr") + " GROUP BY 1", *_EXTRAS))
def target_counts(f):
    """Training rows by target, and how many of them lack a feature before nulls are filled."""
    return learning.marked(_recommender(f).training_frame(f.train, f.interactions, filled=False), FEATURES)


# models: rows only

@query()
def als_recs(f):
    users, items = als.factors_by_block(signals.user_item_weights(f.interactions))
    return learning.dot_scores(users, items, f.recents.select("user_id", "item_id"))


@query()
def pca_embeddings(f):
    v = learning.embeddings(f.items)
    return learning.project(learning.fit_pca(v, 16, sample=100000), v)


@query()
def pca_variance(f):
    model = learning.fit_pca(learning.embeddings(f.items), 32)
    return learning.explained_variance(model, f.spark)


def _trained(f):
    own = _recommender(f)
    rows, _ = own.training_rows(f.train, f.interactions)
    return own.pointwise(rows).model, rows


@query()
def gbt_scores(f):
    model, frame = _trained(f)
    return learning.predict(model, frame).select("user_id", "item_id", "last_status", "target", "score")


@query()
def feature_importance(f):
    return learning.importances(_trained(f)[0], FEATURES, f.spark)
