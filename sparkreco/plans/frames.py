"""The frames that the queries share, derived once from a folder of tables.

What several branches of a plan read is persisted: the cleaned orders, the cleaned tracker, and the frames that come from them (the cutoff, the interactions, the
popularity list of all delivered items, recent items, neighbours). Spark finds a persisted frame again by its plan, also from another query, spills it to disk
if need be, and computes lost parts anew.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreco.operators import candidates as C
from sparkreco.operators import clean, signals
from sparkreco.sources.tables import Retail


class Frames:
    def __init__(self, spark: SparkSession, folder: str):
        # a union that takes over its inputs' partitioning fails where adaptive execution has merged one input's partitions
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        # orders, tracker and interactions lie by user: joins on a user and something else need not move them again
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        self.spark, self.raw = spark, Retail(spark, folder)

    def by_user(self, df: DataFrame) -> DataFrame:
        """df dealt by user; a set number of partitions, so that all frames by user have the same."""
        return df.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "user_id")

    @cached_property
    def orders(self) -> DataFrame:
        return clean.clean_orders(self.by_user(self.raw.orders)).persist()

    @cached_property
    def tracker(self) -> DataFrame:
        return clean.clean_tracker(self.by_user(self.raw.tracker)).persist()

    @cached_property
    def items(self) -> DataFrame:
        return clean.clean_items(self.raw.items)

    @cached_property
    def categories(self) -> DataFrame:
        return self.raw.categories

    @cached_property
    def users(self) -> DataFrame:
        return self.raw.test_users.distinct()

    @cached_property
    def cut(self) -> DataFrame:
        return clean.cutoff(self.orders).persist()

    @cached_property
    def train(self) -> DataFrame:
        return clean.split(self.orders, self.cut)[0]

    @cached_property
    def test(self) -> DataFrame:
        return clean.split(self.orders, self.cut)[1]

    @cached_property
    def interactions(self) -> DataFrame:
        return self.by_user(clean.interactions(self.train, self.tracker, self.cut)).persist()

    @cached_property
    def interaction_parts(self) -> list[DataFrame]:
        """The interactions of orders and of the tracker apart: both lie by user already."""
        return clean.interaction_parts(self.train, self.tracker, self.cut)

    @cached_property
    def delivered(self) -> DataFrame:
        return self.orders.filter("target = 1")

    @cached_property
    def views(self) -> DataFrame:
        return self.tracker.filter("action_type = 'page_view'")

    @cached_property
    def events(self) -> DataFrame:
        return clean.user_events(self.orders, self.tracker)

    @cached_property
    def popular(self) -> DataFrame:
        counts = self.delivered.groupBy("item_id").agg(F.count("*").alias("score"))
        return signals.ranked_items(counts).persist()

    @cached_property
    def n_popular(self) -> DataFrame:
        """One row: how many items have a rank."""
        return self.popular.agg(F.count("*").cast("int").alias("n"))

    @cached_property
    def pairs(self) -> DataFrame:
        return signals.covisitation(self.events).persist()

    @cached_property
    def history(self) -> DataFrame:
        return C.history_of(self.events).persist()

    @cached_property
    def recents(self) -> DataFrame:
        return signals.recent_of_parts(self.interaction_parts, 5).persist()

    @cached_property
    def neighbours(self) -> DataFrame:
        return signals.copurchase(self.train).persist()

    @property
    def _in_categories(self) -> DataFrame:
        return signals.category_items(self.items, self.categories).join(self.popular.select("item_id", "pop_rank"), "item_id", "left")

    @cached_property
    def category_list(self) -> DataFrame:
        return signals.ranked(self._in_categories, ["catalogid"], [F.asc_nulls_last("pop_rank"), F.asc("item_id")], "nth")

    @cached_property
    def category_head(self) -> DataFrame:
        """The first 15 of each category, which is what lists of candidates take: group limits on either side of the shuffle."""
        return signals.top_per_group(self._in_categories, ["catalogid"], [F.asc_nulls_last("pop_rank"), F.asc("item_id")], 15, "nth").persist()

    @cached_property
    def user_features(self) -> DataFrame:
        return signals.entity_features(self.interactions, self.train, "user_id", "user")

    @cached_property
    def item_features(self) -> DataFrame:
        return signals.entity_features(self.interactions, self.train, "item_id", "item")

    @cached_property
    def scored(self) -> DataFrame:
        """Each user's recent items with a simple score, for operators on scored lists."""
        return self.recents.join(self.items.select("item_id", "catalogid"), "item_id").select("user_id", "item_id", "score", "catalogid", "pos")
