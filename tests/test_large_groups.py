"""Operators on keys that hold very many rows, against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkreco.operators import candidates as C
from sparkreco.operators import signals


@pytest.mark.parametrize(("least", "part"), [(5, 2048), (5, 3), (1, 7), (2, 2)])
def test_similar_users_of_lists_of_any_length(spark, least, part):
    rng = random.Random(least * part)
    lists = {u: {1} | set(rng.sample(range(2, 30), rng.randrange(0, 12))) for u in range(60)}  # item 1 is everybody's
    lists |= {100 + u: {1, 2, 3, 4, 5, 6} for u in range(5)} | {200: set(range(1, 30)), 201: {1}, 202: {999}}
    df = spark.createDataFrame([(u, i) for u, s in lists.items() for i in s for _ in range(rng.randrange(1, 3))], "user_id long, item_id long")
    want = {u: v for u in lists for v in [min((v for v in lists if v < u and len(lists[u] & lists[v]) >= least), default=None)] if v is not None}
    assert {r["user_id"]: r["other_id"] for r in C.similar_users(df, least, part).collect()} == want


@pytest.mark.parametrize(("least", "part", "first"), [(5, 2, 1), (3, 4, 2), (5, 8, 1)])
def test_similar_users_of_large_groups_of_longer_keys(spark, least, part, first):
    """every large group goes on to keys of more items, up to those that need no comparison."""
    rng = random.Random(part)
    lists = {u: set(rng.sample(range(14), rng.randrange(2, 9))) for u in range(80)}
    df = spark.createDataFrame([(u, i) for u, s in lists.items() for i in s], "user_id long, item_id long")
    want = {u: v for u in lists for v in [min((v for v in lists if v < u and len(lists[u] & lists[v]) >= least), default=None)] if v is not None}
    assert {r["user_id"]: r["other_id"] for r in C.similar_users(df, least, part, first).collect()} == want


def test_a_common_item_brings_no_users_together(spark):
    rows = [(u, 1) for u in range(300)] + [(u, 10 + u * 7 % 290 + k) for u in range(300) for k in range(4)]
    df = spark.createDataFrame(rows, "user_id long, item_id long")
    plan = C.similar_users(df)
    assert {r["user_id"] for r in plan.collect()} == {u for u in range(300) if any((u - v) * 7 % 290 == 0 for v in range(u))}


@pytest.mark.parametrize("part", [1, 3, 1024])
def test_pairs_of_a_heavy_user(spark, part):
    rng = random.Random(3)
    rows = {(0, i) for i in range(40)} | {(u, rng.randrange(60)) for u in range(1, 12) for _ in range(8)}
    df = spark.createDataFrame(sorted(rows), "user_id long, item_id long")
    by_user = {u: sorted(i for v, i in rows if v == u) for u in range(12)}
    want = sorted((u, a, b) for u, items in by_user.items() for a, b in itertools.combinations(items, 2))
    assert sorted(map(tuple, signals.paired(df, "user_id", "item_id", part).collect())) == want
    counts = {}
    for _, a, b in want:
        counts[a, b] = counts.get((a, b), 0) + 1
    strength = {}
    for (a, b), n in counts.items():
        for x in (a, b) if n >= 2 else ():
            strength[x] = strength.get(x, 0) + n
    assert dict(map(tuple, signals.covisit_strength(df, 2, part).collect())) == strength


def test_a_user_with_100_000_items_is_dealt_and_pruned(spark):
    heavy = spark.range(100000).select(F.lit(0).cast("long").alias("user_id"), F.col("id").alias("item_id"))
    others = spark.range(5 * 3).select((F.col("id") % 5 + 1).alias("user_id"), (F.col("id") % 3).alias("item_id"))
    df = heavy.unionByName(others)
    assert dict(map(tuple, signals.covisit_strength(df).collect())) == {0: 12, 1: 12, 2: 12}
    # unpruned, the heavy user's values lie in many small groups
    sizes = df.groupBy("user_id").agg(F.ceil(F.count("*") / F.lit(1024)).alias("parts")).agg(F.max("parts")).first()[0]
    assert sizes == 98


@pytest.mark.parametrize("n", [0, 1, 7, 50, 100, 1000])
def test_first_rows_with_ties(spark, n):
    rng = random.Random(n)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 50, 1000000])) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, score long").repartition(5)
    want = sorted(rows, key=lambda r: (-r[1], r[0]))[:n]
    assert sorted(map(tuple, signals.first_rows(df, "score", ["id"], n, bins=8).collect())) == sorted(want)
    assert signals.first_rows(df.filter("false"), "score", ["id"], n).collect() == []


def test_covisitation_sorts_in_no_single_task(spark):
    events = spark.createDataFrame([(1, i, "2024-01-01 00:00:00") for i in range(5)], "user_id long, item_id long, t string").withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    plan = signals.covisitation(events, max_pairs=7)
    assert plan.count() == 7
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in text and "GlobalLimit" not in text


@pytest.mark.parametrize(("n", "bins"), [(0, 4), (1, 4096), (40, 4), (90, 1), (200, 4096), (100000, 4)])
def test_covisitation_orders_only_what_can_be_among_the_first(spark, n, bins):
    """all pairs were kept and put in order by ranges, in either order of their items."""
    rng = random.Random(n)
    rows = [(u, rng.choice([rng.randrange(6), rng.randrange(50), 1 << 60]), f"2024-01-0{rng.randrange(1, 5)} 0{rng.randrange(10)}:00:00") for u in range(30) for _ in range(12)] + [(None, 1, "2024-01-01 00:00:00"), (1, None, "2024-01-01 00:00:00"), (2, 7, "2023-01-01 00:00:00"), (2, 8, "2023-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "user_id long, item_id long, t string").withColumn("timestamp", F.col("t").cast("timestamp_ntz"))
    days, counts = {}, {}
    for u, i, t in rows:
        if u is not None and i is not None and t > "2024":
            days.setdefault((u, t[:10]), set()).add(i)
    for items in days.values():
        for x, y in itertools.permutations(items, 2):
            counts[x, y] = counts.get((x, y), 0) + 1
    want = sorted(((x, y, w) for (x, y), w in counts.items()), key=lambda r: (-r[2], r[:2]))[:n]
    found = signals.covisitation(events, max_pairs=n, bins=bins)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "covisits-" in text and "hashpartitioning(item_x" not in text


@pytest.mark.parametrize("part", [1, 3, 1024])
def test_pairs_of_a_long_session(spark, part):
    rows = [(1, 1, i) for i in range(20)] + [(1, 2, 5), (1, 2, 6), (1, 2, 6), (2, 1, 3), (None, 1, 4), (None, 1, 5)]
    pairs, free = signals.session_pairs(spark.createDataFrame(rows, "user_id long, day int, item_id long"), ["user_id", "day"], part)
    assert sorted(map(tuple, pairs.collect())) == sorted([*itertools.combinations(range(20), 2), (5, 6)])
    free()


def test_only_items_of_some_pair_meet_a_history(spark):
    """each candidate met each item of its user's history before the pairs were looked at."""
    candidates = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, 99)], "user_id long, item_id long")
    history = spark.createDataFrame([(1, 20), (1, 21), (1, 22), (2, 88), (3, 20)], "user_id long, item_id long")
    pairs = spark.createDataFrame([(10, 20, 3), (10, 21, 4), (11, 10, 9)], "item_x long, item_y long, weight long")
    found = signals.covisit_features(candidates, history, pairs)
    assert sorted(map(tuple, found.collect())) == [(1, 10, 4, 7, 2), (1, 11, 0, 0, 0), (2, 10, 0, 0, 0), (3, 99, 0, 0, 0)]
    assert found._jdf.queryExecution().executedPlan().toString().count("LeftSemi") >= 2


def test_barred_users_ask_again(spark):
    items = spark.range(200).select(F.col("id").alias("item_id"))
    barred = {1: set(range(150)), 2: set(range(195)), 3: set(), 1004: {5}, 5: set(range(200))}
    positives = spark.createDataFrame([(u, i) for u, s in barred.items() for i in s] + [(3, 777)], "user_id long, item_id long")
    want = {}
    for u, s in barred.items():
        shift = u % 1000 * 104729 % 1000003
        best = sorted((i for i in range(200) if i not in s), key=lambda i: ((i * 7919 + shift) % 1000003, i))[:6]
        want |= {(u, i): r + 1 for r, i in enumerate(best)}
    assert {(r["user_id"], r["item_id"]): r["rank"] for r in C.negatives(positives, items, 6).collect()} == want


def test_scores_without_a_number_come_last(spark):
    scored = spark.createDataFrame([(1, 10, float("nan"), 1), (1, 11, 0.5, 2), (1, 12, None, 3), (1, 13, 0.9, 4)], "user_id long, item_id long, score double, pos int")
    popular = spark.createDataFrame([(13, 0), (20, 1)], "item_id long, pop_rank int")
    users = spark.createDataFrame([(1,), (100,)], "user_id long")
    got = sorted((r["user_id"], r["pos"], r["item_id"]) for r in C.final_ranking(scored, users, popular, 6).collect())
    assert got == [(1, 1, 13), (1, 2, 11), (1, 3, 10), (1, 4, 12), (1, 5, 13), (1, 6, 20), (100, 1, 13), (100, 2, 20), (100, 3, 13), (100, 4, 20)]


def test_pairs_of_items_do_not_move(spark):
    """each pair of a user's items was a row of its own in a shuffle; now an item brings the others as one array."""
    df = spark.range(60).select((F.col("id") % 6).alias("user_id"), F.floor(F.col("id") / 6).alias("item_id"))
    found = signals.covisit_strength(df)
    assert dict(map(tuple, found.collect())) == dict.fromkeys(range(10), 9 * 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a" in plan and "hashpartitioning(a#0, b" not in plan.replace("L", "") and not [x for x in plan.split("hashpartitioning(")[1:] if x.startswith("a#") and ", b#" in x.split(")")[0]]


def test_the_recommender_counts_pairs_once(spark):
    """training and scoring each counted all pairs of items again."""
    from sparkreco.plans import catalog
    from sparkreco.plans.frames import Frames

    own = catalog._recommender(Frames(spark, "/root/testdata/sf0.001"))
    assert "lineitem.parquet" not in own.extras._jdf.queryExecution().executedPlan().toString()


def test_neighbours_move_as_arrays(spark):
    """each neighbour of each item of a history was a row that moved to its user, and every item of a history moved to look for pairs."""
    rng = random.Random(23)
    history = [(u, i, p + 1) for u in range(30) for p, i in enumerate(rng.sample(range(40), rng.randrange(1, 12)))]
    pairs = [(x, y, rng.randrange(1, 4)) for x in range(25) for y in rng.sample([i for i in range(50) if i != x], 8)]
    near = {x: [y for _, y in sorted((-w, y) for a, y, w in pairs if a == x)[:3]] for x, _, _ in pairs}
    want = []
    for u in range(0, 30, 2):
        seen = [i for v, i, _ in history if v == u]
        new = list(dict.fromkeys(y for i in seen for y in near.get(i, ()) if y not in seen))[:6]
        want += [(u, y, p + 1) for p, y in enumerate(new)]
    users = spark.range(0, 40, 2).withColumnRenamed("id", "user_id")
    of = lambda rows, names: spark.createDataFrame(rows, names)
    found = C.covis_lists(of(history, "user_id long, item_id long, pos int"), of(pairs, "item_x long, item_y long, weight long"), users, 3, 6)
    assert sorted(map(tuple, found.select("user_id", "item_id", "pos").collect())) == sorted(want)
    assert "hashpartitioning(user_id, item_id" not in re.sub(r"#\d+L?", "", found._jdf.queryExecution().executedPlan().toString())
