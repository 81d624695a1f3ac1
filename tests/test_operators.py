"""Hand-made frames: ties, empty histories, short lists, defaults, sinks and sources."""

import math

import pytest
from pyspark.sql import functions as F

from sparkreco.functions import scalar as S
from sparkreco.operators import candidates as C
from sparkreco.operators import artifacts, clean, learning, reports, signals, sinks
from sparkreco.sources import tables
from sparkreco.streaming import running

TS = "timestamp_ntz"


def _orders(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, t string, last_status string").select("user_id", "item_id", F.col("t").cast(TS).alias("created_timestamp"), "last_status")


def _tracker(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, t string, action_type string").select("user_id", "item_id", F.col("t").cast(TS).alias("timestamp"), "action_type")


def _pop(spark, n):
    return spark.range(n).select((F.col("id") + 100).alias("item_id"), (n - F.col("id")).alias("score"), F.col("id").cast("int").alias("pop_rank"))


def _lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["user_id"], r["pos"])):
        out.setdefault(r["user_id"], []).append(r["item_id"])
    return out


def test_popularity_list_has_all_items(spark):
    from sparkreco.plans.frames import Frames

    f = Frames(spark, "nowhere")
    # item i is delivered 1 + i % 3 times: more items than any fixed list, with many ties
    f.delivered = spark.range(5000).select(F.col("id").alias("item_id"), F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("n")).drop("n")
    want = sorted(range(5000), key=lambda i: (-(i % 3), i))
    assert [r["item_id"] for r in f.popular.orderBy("pop_rank").collect()] == want
    assert sorted(r["pop_rank"] for r in f.popular.collect()) == list(range(5000)) and f.n_popular.first()["n"] == 5000
    users = spark.createDataFrame([(19,), (49,)], "user_id long")
    assert _lists(C.cold_candidates(users, f.popular, f.n_popular)) == {19: want[2280:2520], 49: want[:240]}  # 49 starts beyond the end
    assert _lists(C.segment_popular(users, f.popular, f.n_popular)) == {19: want[4750:4850], 49: want[2250:2350]}
    got = _lists(C.truncate_by_popularity(spark.createDataFrame([(1, want[4000]), (1, want[3000]), (1, 9999)], "user_id long, item_id long"), f.popular, 3))
    assert got == {1: [want[3000], want[4000], 9999]}


def test_clean_orders_keeps_first_of_each_status(spark):
    o = _orders(spark, [(1, 1, "2024-01-02", "delivered_orders"), (1, 1, "2024-01-01", "delivered_orders"), (1, 1, "2024-01-01", "canceled_orders"), (1, 2, "2024-01-01", "other")])
    got = {(r["item_id"], r["last_status"], str(r["created_timestamp"])[:10], r["target"]) for r in clean.clean_orders(o).collect()}
    assert got == {(1, "delivered_orders", "2024-01-01", 1), (1, "canceled_orders", "2024-01-01", 0)}


@pytest.mark.parametrize(("n", "k"), [(10, 8), (5, 4), (7, 5), (1, 0)])
def test_cutoff_is_an_order_statistic(spark, n, k):
    o = _orders(spark, [(1, i, f"2024-01-{1 + i:02d} 0{i % 3}:00:00", "delivered_orders") for i in range(n)])
    times = sorted(r["created_timestamp"] for r in o.collect())
    cut = clean.cutoff(o)
    assert [r["cutoff"] for r in cut.collect()] == [times[k]]
    train, test = clean.split(o, cut)
    assert train.count() + test.count() == n and train.filter("created_timestamp > '2024-03-01'").count() == 0


def test_interaction_weights(spark):
    o = clean.clean_orders(_orders(spark, [(1, 1, "2024-01-01", "delivered_orders"), (1, 2, "2024-01-11", "delivered_orders")]))
    t = _tracker(spark, [(1, 3, "2024-01-10 12:00:00", "to_cart"), (1, 4, "2024-02-01", "page_view")])
    cut = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-11' AS cutoff")
    got = {r["item_id"]: r["weight"] for r in clean.interactions(o, t, cut).collect()}
    assert set(got) == {1, 2, 3}
    assert math.isclose(got[1], 5 * math.log1p(2)) and math.isclose(got[2], 5 * math.log1p(0.2)) and math.isclose(got[3], 10 * math.log1p(0.2))
    faded = {r["item_id"]: r["weight"] for r in clean.interactions(o, t, cut, decay=True).collect()}
    assert faded[1] < faded[2]


def test_features_default_to_zero(spark):
    o = clean.clean_orders(_orders(spark, [(1, 1, "2024-01-01", "delivered_orders")]))
    i = spark.createDataFrame([(2, 5, 3.0), (2, 5, 1.0)], "user_id long, item_id long, weight double")
    got = {r["user_id"]: r for r in signals.entity_features(i, o, "user_id", "user").collect()}
    assert (got[1]["user_count"], got[1]["user_max"], got[1]["user_mean"], got[1]["user_orders_count"]) == (0, 0, 0, 1)
    assert (got[2]["user_count"], got[2]["user_mean"], got[2]["user_min"], got[2]["user_orders_count"]) == (2, 2.0, 1.0, 0)


def test_decayed_history_only_beyond_recent_n(spark):
    o = _orders(spark, [(1, i, f"2024-01-0{i}", "delivered_orders") for i in range(1, 5)] + [(2, 1, "2024-01-01", "delivered_orders")])
    got = {(r["user_id"], r["item_id"]): r["weight"] for r in signals.decayed_history(o, 2).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 1.0, (1, 3): 0.5, (1, 4): 0.5, (2, 1): 1.0}


def test_copurchase_rows(spark):
    o = _orders(spark, [(1, 1, "2024-01-01", "delivered_orders"), (1, 2, "2024-01-01", "delivered_orders"), (1, 3, "2024-01-01", "delivered_orders"), (2, 1, "2024-01-02", "delivered_orders"), (2, 1, "2024-01-02", "canceled_orders"), (3, 9, "2024-01-02", "delivered_orders")])
    got = {(r["item_id"], r["nbr_id"]): r["strength"] for r in signals.copurchase(o).collect()}
    # item 1: a third with 2, a third with 3, and with itself two times a half
    assert got[1, 1] == 0.6 and got[1, 2] == got[1, 3] == 0.2 and got[2, 1] == got[2, 3] == 0.5 and not any(9 in p for p in got)
    assert {r["rank"] for r in signals.copurchase(o, top_n=1).collect()} == {1}


def test_category_expansion(spark):
    items = spark.createDataFrame([(1, 5), (2, 7), (3, None), (4, 0)], "item_id long, catalogid int")
    cats = spark.createDataFrame([(5, [1, 5]), (7, [5, 7]), (8, [1, 8])], "catalogid int, ids array<int>")
    assert {(r["catalogid"], r["item_id"]) for r in signals.category_items(items, cats).collect()} == {(5, 1), (7, 2), (7, 1), (0, 4)}


def test_fill_up_and_repeat(spark):
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    lists = spark.createDataFrame([(1, 101, 1), (1, 7, 2)], "user_id long, item_id long, pos int")
    full = _lists(C.fill_up(lists, users, _pop(spark, 10), 5))
    assert full == {1: [101, 7, 100, 102, 103], 2: [100, 101, 102, 103, 104]}
    short = _lists(C.fill_up(lists, users, _pop(spark, 2), 5))
    assert short == {1: [101, 7, 100], 2: [100, 101]}
    assert _lists(C.repeat_to(lists, 5)) == {1: [101, 7, 101, 7, 101]}
    assert _lists(C.repeat_to(lists, 3, users, _pop(spark, 2)))[2] == [100, 101, 100]


def test_cold_candidates_wrap(spark):
    n = 600
    pop = _pop(spark, n)
    users = spark.createDataFrame([(0,), (4,), (49,), (50,)], "user_id long")
    got = _lists(C.cold_candidates(users, pop, n))
    ranks = list(range(100, 100 + n))
    for u in (0, 4, 49, 50):
        s, p = (u % 50) * 120, 240
        if s + p <= n:
            want = ranks[s : s + p]
        else:
            want = ranks[s:] + ranks[: p - len(ranks[s:])]
            want += ranks[500 : 500 + p - len(want)]
        assert got[u] == want[:300]


def test_fill_up_edges(spark):
    lists = spark.createDataFrame([(1, 101, 1), (1, 7, 2), (9, 8, 1)], "user_id long, item_id long, pos int")
    users = spark.createDataFrame([(1,), (1,), (2,)], "user_id long")
    assert _lists(C.fill_up(lists, users, _pop(spark, 10), 4)) == {1: [101, 7, 100, 102], 2: [100, 101, 102, 103], 9: [8]}
    none = _pop(spark, 10).limit(0)
    assert _lists(C.fill_up(lists, users, none, 4)) == {1: [101, 7], 9: [8]}
    assert _lists(C.fill_up(lists.limit(0), users.limit(0), _pop(spark, 10), 4)) == {}


def test_warm_candidates_order(spark):
    users = spark.createDataFrame([(3,)], "user_id long")
    history = spark.createDataFrame([(3, 1, 1), (3, 2, 2), (3, 99, 3)], "user_id long, item_id long, pos int")
    near = spark.createDataFrame([(1, 5, 0.5, 1), (1, 2, 0.4, 2), (2, 6, 0.1, 1)], "item_id long, nbr_id long, strength double, rank int")
    cats = spark.createDataFrame([(1, 4), (2, 4), (5, 0), (6, None), (7, 4)] + [(i, 9) for i in range(100, 160)], "item_id long, catalogid int")
    listed = spark.createDataFrame([(4, 7, 1), (4, 1, 2)], "catalogid int, item_id long, nth int")
    got = _lists(C.warm_candidates(users, history, near, cats, listed, _pop(spark, 60)))[3]
    assert got[:6] == [1, 2, 5, 6, 7, 153] and len(got) == len(set(got))


def test_final_ranking_fills_and_repeats(spark):
    users = spark.createDataFrame([(0,), (1,)], "user_id long")
    scored = spark.createDataFrame([(0, 100, 0.5, 2), (0, 9, 0.5, 1)], "user_id long, item_id long, score double, pos int")
    got = _lists(C.final_ranking(scored, users, _pop(spark, 4), 6))
    assert got[0] == [9, 100, 101, 102, 103, 100] and got[1] == [102, 103, 100, 101, 102, 103]


def test_diversify(spark):
    rows = [(1, i, 1.0 - i / 10, 5 if i < 4 else None) for i in range(6)]
    scored = spark.createDataFrame(rows, "user_id long, item_id long, score double, catalogid int")
    assert _lists(C.diversify(scored, 5))[1] == [0, 1, 4, 5, 2]
    assert _lists(C.diversify(scored, 6))[1] == [0, 1, 2, 3, 4, 5]


def test_explore_takes_last_places(spark):
    recs = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "user_id long, item_id long, pos int")
    fresh = spark.createDataFrame([(1, 2, 1), (1, 50, 2), (1, 51, 3)], "user_id long, item_id long, rank int")
    assert _lists(C.explore(recs, fresh, 5, 2))[1] == [1, 2, 3, 50, 4]


def test_spread_sample_matches_full_order(spark):
    users = spark.createDataFrame([(u,) for u in (1, 77, 1500, 2001)], "user_id long")
    items = spark.range(1, 400).withColumnRenamed("id", "item_id")
    had = spark.createDataFrame([(1, i) for i in range(1, 60)], "user_id long, item_id long")
    got = {}
    for r in C.spread_sample(users, items, 7, had).collect():
        got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"]))
    for u in (1, 77, 1500, 2001):
        free = [i for i in range(1, 400) if not (u == 1 and i < 60)]
        want = sorted(free, key=lambda i: ((i * 7919 + (u % 1000) * 104729) % 1000003, i))[:7]
        assert [i for _, i in sorted(got[u])] == want


def test_ndcg(spark):
    recs = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 5, 1)], "user_id long, item_id long, pos int")
    truth = spark.createDataFrame([(1, 11), (1, 12), (3, 1)], "user_id long, item_id long")
    got = {r["user_id"]: r["ndcg"] for r in learning.ndcg_lists(recs, truth).collect()}
    assert got == {1: round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6), 3: 0.0}
    rows = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.1, 0), (2, 1, 0.5, 1), (3, 1, 0.5, 0), (3, 2, 0.4, 0)], "user_id long, item_id long, score double, label int")
    assert learning.ndcg_grouped(rows, 2).first()["ndcg"] == round(2 / 3, 6)
    assert tuple(learning.ndcg_grouped(rows, 2, fast=True).first()) == (1.0, 1)


def test_past_join_variants(spark):
    o = clean.clean_orders(_orders(spark, [(1, 1, "2024-01-05", "delivered_orders"), (1, 2, "2024-01-05", "delivered_orders")]))
    e = spark.createDataFrame([(1, 1, 2.0, "2024-01-06"), (1, 1, 3.0, "2024-01-01")], "user_id long, item_id long, weight double, t string").select("user_id", "item_id", "weight", F.col("t").cast(TS).alias("timestamp"))
    safe = learning.past_join(o, e)
    assert sorted((r["item_id"], r["weight"]) for r in safe.collect()) == [(1, 3.0), (2, None)] or {(r["item_id"], r["weight"]) for r in safe.collect()} == {(1, 3.0), (2, None)}
    late = e.filter("weight = 2.0")
    assert learning.past_join(o, late, literal=True).count() == 1 and learning.past_join(o, late).count() == 2
    assert learning.leaks(safe).first()["leaks"] == 0


def test_scalars(spark):
    df = spark.createDataFrame([("[1.5, 2, x]",), ("[0.5 1]",), ("[]",), (None,)], "s string")
    assert [r["v"] for r in df.select(S.parse_vector("s").alias("v")).collect()] == [[1.5, 2.0, None], [0.5, 1.0], [], None]
    v = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<float>, b array<float>")
    row = v.select(S.dot("a", "b").alias("d"), S.norm("a").alias("n"), S.normalized("a").alias("u"), S.resized(F.col("a"), 3).alias("r")).first()
    assert (row["d"], row["n"], row["u"], row["r"]) == (3.0, 5.0, [0.6, 0.8], [3.0, 4.0, 0.0])
    codes = learning.factorized(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string"), "c")
    assert {(r["c"], r["code"]) for r in codes.collect()} == {(None, 0), ("a", 1), ("b", 2)}


def test_id_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 613).alias("k"))
    got = {r["k"]: r["idx"] for r in learning.id_index(df, "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted({i * 7 % 613 for i in range(1000)}))}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(1,)] * 1 + [(2,)] * 11 + [(3,)] * 6, "user_id long")
    assert {r["bin"]: r["keys"] for r in reports.histogram(df, "user_id", 10).collect()} == {0: 1, 9: 1, 5: 1}
    assert reports.histogram(df.filter("user_id = 1"), "user_id", 10).first()["bin"] == 0


def test_sources_and_sinks(spark, tmp_path):
    recs = spark.createDataFrame([(1, 7, 2), (1, 5, 1), (2, 9, 1)], "user_id long, item_id long, pos int")
    sinks.write_submission(recs, f"{tmp_path}/out.csv", 2)
    read = spark.read.option("header", True).csv(f"{tmp_path}/out.csv")
    assert read.columns[0] == "user_id" and {tuple(r) for r in read.collect()} == {("1", "5 7"), ("2", "9")}
    o = _orders(spark, [(1, 1, "2024-01-01", "delivered_orders")])
    for k in range(3):
        o.coalesce(1).write.parquet(f"{tmp_path}/orders/part{k}")
    assert tables.load(spark, f"{tmp_path}/orders", "orders", ["user_id"]).count() == 3
    assert tables.load(spark, f"{tmp_path}/orders", "orders", max_files=2).count() == 2
    assert tables.load_optional(spark, f"{tmp_path}/none", "tracker").columns == ["user_id", "item_id", "timestamp", "action_type"]
    with pytest.raises(FileNotFoundError):
        tables.concat([])
    with pytest.raises(TypeError):
        tables.check_id_type(spark.createDataFrame([("1",)], "item_id string"))
    frame = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "x double, target int")
    model = learning.train_ranker(frame, ["x"], rounds=2)
    artifacts.save_artifacts(f"{tmp_path}/bundle", {"recs": recs}, {"model": model}, ["x"])
    t, m, features = artifacts.load_artifacts(spark, f"{tmp_path}/bundle")
    assert t["recs"].count() == 3 and features == ["x"] and learning.predict(m["model"], frame).count() == 40


def test_embeddings(spark):
    items = spark.createDataFrame([(i, [float(i), 1.0, float(i % 3)]) for i in range(30)] + [(50, None), (51, [])], "item_id long, fclip_embed array<float>")
    v = learning.embeddings(items)
    assert v.count() == 30
    model = learning.fit_pca(v, 2)
    assert len(learning.project(model, v).first()["vector"]) == 2
    variance = learning.explained_variance(learning.fit_pca(v, 3), spark)
    assert abs(variance.agg(F.max("cumulative")).first()[0] - 1) < 1e-6 and learning.components_for(variance, 0.4).first()["k"] in (1, 2)


def test_streaming_states(spark, tmp_path):
    events = spark.createDataFrame([(1, 5, 2.0, "2024-01-01 10:00:00"), (1, 5, 1.0, "2024-01-01 11:00:00"), (1, 6, 9.0, "2024-01-02 01:00:00"), (2, 5, 4.0, "2024-01-02 02:00:00")], "user_id long, item_id long, weight double, t string").select("user_id", "item_id", "weight", F.col("t").cast("timestamp").alias("timestamp"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, df, mode in (("sums", running.running_weights(stream), "update"),):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
    assert {(r["user_id"], r["item_id"]): r["weight"] for r in spark.table("sums").collect()} == {(1, 5): 3.0, (1, 6): 9.0, (2, 5): 4.0}
    seen = []
    weighted = stream.withColumn("weight", F.lit(1.0))
    running.refit_each_batch(weighted, running.refit_factors(f"{tmp_path}/history", rank=2), f"{tmp_path}/factors").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/history/factors/0/user").count() == spark.read.parquet(f"{tmp_path}/history/weights").select("user_id").distinct().count()
    query = running.refit_each_batch(stream, lambda df, k: seen.append(df.count()), f"{tmp_path}/refit")
    query.awaitTermination()
    assert sum(seen) == 4


def test_recommender_round_trip(spark, tmp_path):
    from sparkreco.operators.recommender import Recommender

    users = spark.createDataFrame([(u, float(u % 4)) for u in range(12)], "user_id long, user_mean double")
    items = spark.createDataFrame([(i, float(i % 3)) for i in range(6)], "item_id long, item_mean double")
    past = spark.createDataFrame([(1, 1, 2.0, 1)], "user_id long, item_id long, past_weight double, past_events long")
    own = Recommender(users, items, past, _pop(spark, 6), features=["past_weight", "user_mean", "item_mean"])
    orders = _orders(spark, [(u, i, f"2024-01-0{1 + i} 00:00:00", "delivered_orders" if (u + i) % 2 else "canceled_orders") for u in range(12) for i in range(6)]).withColumn("target", (F.col("last_status") == "delivered_orders").cast("int"))
    events = spark.createDataFrame([(1, 1, 2.0, "2023-12-01")], "user_id long, item_id long, weight double, t string").select("user_id", "item_id", "weight", F.col("t").cast(TS).alias("timestamp"))
    trained = own.train(orders, events, rounds=2, depth=2)
    trained.save(f"{tmp_path}/model")
    again = Recommender.load(spark, f"{tmp_path}/model")
    candidates = spark.createDataFrame([(u, i, i + 1) for u in (1, 2) for i in range(4)], "user_id long, item_id long, pos int")
    asked = spark.createDataFrame([(1,), (2,), (7,)], "user_id long")
    lists = [sorted(map(tuple, r.recommend(candidates, asked, 5).select("user_id", "pos", "item_id").collect())) for r in (trained, again)]
    assert lists[0] == lists[1] and len(lists[0]) == 15 and [p for u, p, _ in lists[0] if u == 1] == [1, 2, 3, 4, 5]
    stored = trained.frame(candidates).withColumn("target", (F.col("item_id") == 2).cast("int"))
    sinks.write_table(stored, f"{tmp_path}/validation")
    found = again.evaluate(spark.read.parquet(f"{tmp_path}/validation")).first()
    assert 0 < found["ndcg"] <= 1 and found["users"] == 2
    sinks.write_table(stored.limit(1), f"{tmp_path}/validation", mode="ignore")
    assert spark.read.parquet(f"{tmp_path}/validation").count() == 8


def test_lists_of_users_with_the_same_recents(spark):
    rows = [(u, i) for u, items in {1: [1, 2, 3], 2: [3, 2, 1], 3: [1, 2], 4: [1, 2, 3], 5: [1, 2, 4]}.items() for i in items]
    similar = C.same_recents(spark.createDataFrame(rows, "user_id long, item_id long"), 3)
    assert {tuple(r) for r in similar.select("user_id", "other_id").collect()} == {(2, 1), (4, 1)}
    recs = spark.createDataFrame([(1, 7, 1), (2, 8, 1), (4, 9, 1), (5, 6, 1)], "user_id long, item_id long, pos int")
    assert {(r["user_id"], r["item_id"]) for r in C.reuse_lists(recs, similar).collect()} == {(1, 7), (2, 7), (4, 7), (5, 6)}


def test_factors_of_wide_ids_and_a_stored_projection(spark, tmp_path):
    far = 1 << 60
    weights = spark.createDataFrame([(far + u, far - i, float(1 + u * i)) for u in range(4) for i in range(3)], "user_id long, item_id long, weight double")
    model, users, items = learning.factorize_ids(weights, rank=2)
    assert learning.factor_scores(model, learning.indexed(weights, users, items)).count() == 12
    vectors = spark.createDataFrame([(i, [float(i), float(i * i % 5), 1.0 / (1 + i)]) for i in range(8)], "item_id long, vector array<double>")
    pca = learning.fit_pca(vectors, 2)
    artifacts.save_artifacts(f"{tmp_path}/a", {}, {"pca": pca})
    stored = artifacts.load_artifacts(spark, f"{tmp_path}/a")[1]["pca"]
    new = spark.createDataFrame([(9, [2.0, 1.0, 0.5])], "item_id long, vector array<double>")
    assert learning.project(stored, new).first()["vector"] == learning.project(pca, new).first()["vector"]


def test_arrays_and_times(spark):
    df = spark.createDataFrame([([1, 2, 3], [5, 3, 4], "2024-01-02 03:04:05"), ([], [1], "soon")], "a array<int>, b array<int>, t string")
    got = df.select(S.merged_arrays("a", "b", 4).alias("m"), S.parse_time("t").isNull().alias("bad")).collect()
    assert [(r["m"], r["bad"]) for r in got] == [([4, 3, 5, 1], False), ([1], True)]
