"""Cleaning, splitting and weighing of orders, tracker events, items and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkreco.functions.scalar import ACTION_WEIGHTS, ORDER_WEIGHT, TARGET_ROOTS, days_between, lookup, micros


def clean_orders(orders: DataFrame) -> DataFrame:
    """Delivered and canceled orders, once for each user, item and status (the first), with target 1 or 0."""
    once = orders.filter(F.col("last_status").isin("delivered_orders", "canceled_orders")).groupBy("user_id", "item_id", "last_status").agg(F.min("created_timestamp").alias("created_timestamp"))
    return once.withColumn("target", (F.col("last_status") == "delivered_orders").cast("int"))


def clean_tracker(tracker: DataFrame, actions: tuple[str, ...] = tuple(ACTION_WEIGHTS)) -> DataFrame:
    return tracker.filter(F.col("action_type").isin(*actions)).dropDuplicates(["user_id", "item_id", "action_type", "timestamp"])


def clean_items(items: DataFrame) -> DataFrame:
    """One row an item: the one with the least category."""
    rest = [c for c in items.columns if c not in ("item_id", "catalogid")]
    best = items.groupBy("item_id").agg(F.min_by(F.struct(*rest), "catalogid").alias("b"), F.min("catalogid").alias("catalogid"))
    return best.select("item_id", *[f"b.{c}" for c in rest], "catalogid").select(*items.columns)


def delivered_only(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("last_status") == "delivered_orders").drop("last_status")


def not_canceled(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("last_status") != "canceled_orders")


def items_under(items: DataFrame, categories: DataFrame, roots: tuple[int, ...] = TARGET_ROOTS, depth: int | None = None) -> DataFrame:
    """Items of the categories with one of the roots among their ids; with depth, only of those with so many ids."""
    ok = F.arrays_overlap("ids", F.array(*[F.lit(r) for r in roots]))
    allowed = categories.filter(ok & (F.size("ids") == depth) if depth else ok).select("catalogid")
    return items.join(allowed, "catalogid", "left_semi")


def recent(df: DataFrame, days: int, ts: str = "timestamp") -> DataFrame:
    """Rows of the last days before the latest row."""
    latest = df.agg(F.max(ts).alias("__latest"))
    return df.crossJoin(F.broadcast(latest)).filter(F.col(ts) >= F.expr(f"__latest - make_dt_interval({days})")).drop("__latest")


def before_user_cutoff(df: DataFrame, cutoffs: DataFrame, ts: str) -> DataFrame:
    """Rows earlier than their user's cutoff."""
    return df.join(cutoffs, "user_id").filter(F.col(ts) < F.col("cutoff")).drop("cutoff")


def cutoff(orders: DataFrame, test_share: float = 0.2, ts: str = "created_timestamp") -> DataFrame:
    """One row: the k-th least time, k = int(n * (1 - test_share)), without sorting rows in one place.

    Times are counted first, running sums go day by day, and only the days' totals (one row a day) are summed up in one task.
    """
    counts = orders.groupBy(ts).count().withColumn("day", F.to_date(ts))
    days = counts.groupBy("day").agg(F.sum("count").alias("n"))
    whole = Window.orderBy("day")
    before = days.select("day", (F.sum("n").over(whole) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    upto = counts.withColumn("upto", F.sum("count").over(Window.partitionBy("day").orderBy(ts))).join(F.broadcast(before), "day")
    k = F.floor(F.col("total") * F.lit(1 - test_share))
    return upto.filter((F.col("before") + F.col("upto") > k) & (F.col("before") + F.col("upto") - F.col("count") <= k)).select(F.col(ts).alias("cutoff"))


def split(orders: DataFrame, cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training orders up to the cutoff, test orders after it."""
    both = orders.crossJoin(F.broadcast(cut))
    return both.filter("created_timestamp <= cutoff").drop("cutoff"), both.filter("created_timestamp > cutoff").drop("cutoff")


def interactions(train: DataFrame, tracker: DataFrame, cut: DataFrame, weights: dict[str, float] = ACTION_WEIGHTS, decay: bool = False) -> DataFrame:
    """Orders and earlier tracker events as weighted interactions: base * ln(1 + days / 5), days back from the latest training order.

    decay: divide by the logarithm instead, so that weights fall with age.
    """
    bought, events = interaction_parts(train, tracker, cut, weights, decay)
    return bought.unionByName(events)


def interaction_parts(train: DataFrame, tracker: DataFrame, cut: DataFrame, weights: dict[str, float] = ACTION_WEIGHTS, decay: bool = False) -> list[DataFrame]:
    """The interactions that are orders, and those that are tracker events: each lies as its table does."""
    ref = train.agg(F.max("created_timestamp").alias("ref"))
    events = tracker.crossJoin(F.broadcast(cut)).filter("timestamp < cutoff").select("user_id", "item_id", "timestamp", "action_type")
    bought = train.select("user_id", "item_id", F.col("created_timestamp").alias("timestamp"), F.lit("order").alias("action_type"))
    days = F.greatest(days_between(micros("ref"), micros("timestamp")), F.lit(1))
    scale = F.log1p(days / F.lit(5.0))
    base = lookup("action_type", {**weights, "order": ORDER_WEIGHT})
    return [df.crossJoin(F.broadcast(ref)).select("user_id", "item_id", (base / scale if decay else base * scale).alias("weight"), "timestamp", "action_type") for df in (bought, events)]


def hash_split(df: DataFrame, key: str = "user_id", percent: int = 80) -> DataFrame:
    """is_train by an arithmetic hash of the key, so that all rows of a key fall on one side."""
    return df.withColumn("is_train", (F.pmod(F.col(key) * 7919, F.lit(100)) < percent).cast("int"))


def user_events(orders: DataFrame, tracker: DataFrame) -> DataFrame:
    """Purchases and clicks in one log: (user_id, item_id, timestamp, event_type, event_value)."""
    bought = orders.select("user_id", "item_id", F.col("created_timestamp").alias("timestamp"), F.lit("purchase").alias("event_type"))
    seen = tracker.select("user_id", "item_id", "timestamp", F.lit("click").alias("event_type"))
    return bought.unionByName(seen).withColumn("event_value", F.lit(1))
