"""What moves: plans over the shared frames, by the keys of their shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from sparkreco.operators import candidates as C
from sparkreco.operators import learning, signals
from sparkreco.operators.recommender import FEATURES
from sparkreco.plans.frames import Frames

SF = "/root/testdata/sf0.001"


def pair_shuffles(df) -> list[str]:
    """Shuffles by a user and something else, which frames that lie by user don't need."""
    df.collect()  # the final plan knows how persisted frames lie
    final = df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    return re.findall(r"hashpartitioning\(user_id#\d+L?, [a-z_]+#\d+L?, .*?\)", final)


@pytest.fixture
def frames(spark):
    # plain shuffle joins, as tables of any size have them
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield Frames(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_orders_meet_their_users_interactions_where_they_lie(frames):
    assert pair_shuffles(learning.training_set(frames.train, frames.interactions, frames.user_features, frames.item_features)) == []


def test_users_and_the_popular_list_are_no_product_that_moves(spark):
    users, popular = spark.range(40).selectExpr("id AS user_id"), spark.range(9).selectExpr("id + 100 AS item_id", "cast(id as int) AS pop_rank")
    seen = spark.createDataFrame([(1, 100), (1, 102), (1, 100), (2, 999)], "user_id long, item_id long")
    found = C.unseen_popular(users, popular, seen, 3)
    assert pair_shuffles(found) == []
    assert {r["user_id"]: 0 for r in found.collect()}.keys() == set(range(40))
    assert sorted(map(tuple, found.filter("user_id < 3").collect())) == [(0, 100, 1), (0, 101, 2), (0, 102, 3), (1, 101, 1), (1, 103, 2), (1, 104, 3), (2, 100, 1), (2, 101, 2), (2, 102, 3)]


def test_recent_items_come_from_parts(spark, frames):
    """all interactions moved once more and were kept before each user's few recent items were chosen."""
    whole = signals.recent_items(frames.interactions, 5)
    parts = signals.recent_of_parts(frames.interaction_parts, 5)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    other = Frames(spark, SF)
    other.recents  # noqa: B018
    assert "interactions" not in other.__dict__
    rows = [(u, i, float(w), f"2024-01-{d:02d} 00:00:00") for u, i, w, d in ((u, (u * 7 + k) % 9, (k * 5) % 4, 1 + k) for u in range(6) for k in range(20))]
    df = spark.createDataFrame(rows, "user_id long, item_id long, weight double, t string").withColumn("timestamp", F.col("t").cast("timestamp_ntz")).drop("t")
    halves = [df.filter("item_id + weight <= 6"), df.filter("item_id + weight > 6")]
    for n in (1, 3, 50):
        assert sorted(map(tuple, signals.recent_of_parts(halves, n).collect())) == sorted(map(tuple, signals.recent_items(df, n).collect()))


def test_candidates_stay_with_their_users(frames):
    """all candidates went to their items and returned with the features; few have items that are candidates seldom."""
    from dataclasses import replace

    from sparkreco.plans import catalog

    found, own = catalog._candidates(frames), catalog._recommender(frames)
    shuffles = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].count("Exchange hashpartitioning("))[1]
    assert shuffles(found.groupBy("user_id").agg(F.sum("item_id"), F.sum("pos"))) == shuffles(found)
    some = lambda r: sorted(map(str, r.frame(found).filter("user_id % 20 = 0").select("user_id", "item_id", "pos", *FEATURES).select("user_id", "item_id", "pos", *[F.round(c, 9).alias(c) for c in FEATURES]).collect()))
    few = replace(own, often=own.often.filter("item_id % 3 = 0"))
    assert some(few) == some(own) == some(replace(own, often=None))
