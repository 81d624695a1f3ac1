"""Candidate lists in long form (user_id, pos, item_id) or (user_id, item_id, rank), with positions from 1; ranking and filling up.

Sequential rules are set operations here: each source emits (user, item, source, position), the least pair per user and item
stays, and positions are counted anew. Popularity lists that lists are filled from are cut to the length that can matter
before they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreco.operators.signals import numbered, ranked, top_per_group
from sparkreco.operators.sinks import stage


def _as_one(df: DataFrame, order: list[str]) -> Column:
    """One column of the same order: a number, which can be aggregated by hashing, where the columns are whole numbers.

    Of three, the first is a source's place from -1 to 6, the second a position, the third a place in a list (below 2^29).
    """
    if len(order) == 1:
        return F.col(order[0])
    if any(dict(df.dtypes)[c] != "int" for c in order) or len(order) > 3:
        return F.struct(*order)
    *lead, a, b = (F.col(c).cast("long") for c in order)
    if not lead:
        return F.shiftleft(a, 32) + b
    return F.shiftleft(lead[0] + 1, 60) + F.shiftleft(a, 29) + b


def first_occurrences(df: DataFrame, order: list[str], k: int | None = None) -> DataFrame:
    """Each user's items once, at the least of `order`; positions counted anew; the first k. One shuffle, by user, serves both steps."""
    least = df.repartition("user_id").groupBy("user_id", "item_id").agg(F.min(_as_one(df, order)).alias("__o"))
    out = ranked(least, ["user_id"], [F.asc("__o"), F.asc("item_id")], "pos").drop("__o")
    return out.filter(F.col("pos") <= k) if k else out


def listed(lists: DataFrame) -> DataFrame:
    """(user_id, own): each user's list in one row, by pos. For lists that are cut to a length before."""
    return lists.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id"))).getField("item_id").alias("own"))


def unlisted(own: DataFrame) -> DataFrame:
    """The rows of `listed` as (user_id, item_id, pos) again."""
    return own.select("user_id", F.posexplode("own").alias("at", "item_id")).select("user_id", "item_id", (F.col("at") + 1).cast("int").alias("pos"))


def head_of(popular: DataFrame, k: int) -> DataFrame:
    """One row (head): the items of the ranks 0 to k - 1 in this order; null at a rank that popular doesn't have."""
    ranks = popular.filter(F.col("pop_rank") < k).agg(F.map_from_entries(F.collect_list(F.struct("pop_rank", "item_id"))).alias("m"))
    return ranks.select(F.expr(f"transform(sequence(0, {k - 1}), r -> try_element_at(m, r))").alias("head"))


def fill_up(lists: DataFrame, users: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """Lists of at most k items, filled with popular items that aren't in them; popular: (item_id, pop_rank from 0).

    A list of n items leaves k - n places, and at most n of the first k popular items are in it: the first k suffice. They are one
    row, so nothing but the lists moves, and these are partitioned by user already.
    """
    return fill_listed(listed(lists), users, popular, k)


def fill_listed(lists: DataFrame, users: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """As fill_up, of lists (user_id, own)."""
    every = users.select("user_id", F.lit(True).alias("open")).distinct().join(lists, "user_id", "full").crossJoin(F.broadcast(head_of(popular, k)))
    own = F.coalesce("own", F.expr("slice(head, 1, 0)"))
    places = F.when(F.col("open"), F.greatest(F.lit(k) - F.size(own), F.lit(0))).otherwise(0)
    return unlisted(every.select("user_id", F.concat(own, F.slice(F.array_except(F.array_compact("head"), own), F.lit(1), places)).alias("own")))


def recent_lists(events: DataFrame, users: DataFrame, last_n: int, k: int) -> DataFrame:
    """The users' latest items, not filled up."""
    own = events.join(users.select("user_id"), "user_id", "left_semi")
    last = top_per_group(own, ["user_id"], [F.desc("timestamp"), F.desc("item_id"), F.desc("event_type")], last_n, "at")
    return first_occurrences(last, ["at"], k)


def recent_candidates(events: DataFrame, users: DataFrame, popular: DataFrame, last_n: int, k: int) -> DataFrame:
    return fill_up(recent_lists(events, users, last_n, k), users, popular, k)


def history_of(events: DataFrame) -> DataFrame:
    """Each user's items in the order of their first event."""
    return first_occurrences(events, ["timestamp"])


def covis_listed(history: DataFrame, pairs: DataFrame, users: DataFrame, per_item: int, k: int) -> DataFrame:
    """(user_id, own): neighbours of the history's items in its order, without the history, in one row a user.

    An item brings its neighbours as one array; only items that are in some pair move, and the pairs are a bounded list. What a user has seen
    is an array where the history lies.
    """
    near = top_per_group(pairs, ["item_x"], [F.desc("weight"), F.asc("item_y")], per_item, "nbr").groupBy(F.col("item_x").alias("item_id"))
    near = near.agg(F.array_sort(F.collect_list(F.struct("nbr", "item_y"))).getField("item_y").alias("near"))
    own = history.join(users.select("user_id"), "user_id", "left_semi")
    met = own.join(F.broadcast(pairs.select(F.col("item_x").alias("item_id")).distinct()), "item_id", "left_semi").join(near, "item_id")
    found = met.groupBy("user_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("pos", "near"))).getField("near")).alias("found"))
    seen = own.groupBy("user_id").agg(F.collect_list("item_id").alias("seen"))
    # what is left is once each, at its first place
    new = found.join(seen, "user_id").select("user_id", F.slice(F.array_except("found", "seen"), 1, k).alias("own"))
    return new.filter(F.size("own") > 0)


def covis_lists(history: DataFrame, pairs: DataFrame, users: DataFrame, per_item: int, k: int) -> DataFrame:
    """The lists of covis_listed as (user_id, item_id, pos)."""
    return unlisted(covis_listed(history, pairs, users, per_item, k))


def covis_candidates(history: DataFrame, pairs: DataFrame, users: DataFrame, popular: DataFrame, per_item: int, k: int) -> DataFrame:
    return fill_listed(covis_listed(history, pairs, users, per_item, k), users, popular, k)


def merge_lists(sources: list[DataFrame], users: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """Lists by the sources' order, once each; filled up."""
    out = None
    for prio, s in enumerate(sources):
        own = s.select("user_id", "item_id", F.lit(prio).alias("prio"), F.col("pos").alias("at"))
        out = own if out is None else out.unionByName(own)
    return fill_up(first_occurrences(out, ["prio", "at"], k), users, popular, k)


def stretches(classes: DataFrame, popular: DataFrame) -> DataFrame:
    """(cls, items): for each of a bounded number of classes (cls, s, n) the popular items of the ranks s to s + n - 1, in this order."""
    asked = classes.filter("n > 0").select("cls", F.explode(F.expr("sequence(s, s + n - 1)")).alias("pop_rank"))
    met = popular.select("item_id", "pop_rank").join(F.broadcast(asked), "pop_rank")
    return met.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("pop_rank", "item_id"))).getField("item_id").alias("items"))


def _with_length(users: DataFrame, n: DataFrame | int) -> DataFrame:
    return users.withColumn("n", F.lit(n)) if isinstance(n, int) else users.crossJoin(F.broadcast(n))


def cold_reach(size: int = 300) -> int:
    """How many of the first popular items cold lists are made of."""
    p = int(size * 0.8)
    return max(49 * (p // 2) + p, 500 + p)


def cold_classes(popular: DataFrame, n_popular: DataFrame | int, size: int = 300) -> DataFrame:
    """(cls, own): the cold list of the users whose user_id % 50 is cls; a list may hold an item twice."""
    p = int(size * 0.8)
    head = head_of(popular, cold_reach(size))
    c = _with_length(popular.sparkSession.range(50).select(F.col("id").alias("cls"), (F.col("id") * (p // 2)).cast("int").alias("start")), n_popular).crossJoin(F.broadcast(head))
    c = c.withColumn("l1", F.least(F.lit(p), F.greatest(F.col("n") - F.col("start"), F.lit(0))))
    c = c.withColumn("l2", F.least(F.lit(p) - F.col("l1"), F.col("n"))).withColumn("l3", F.greatest(F.lit(p) - F.col("l1") - F.col("l2"), F.lit(0)))
    parts = F.concat(F.slice("head", F.col("start") + 1, F.col("l1")), F.slice("head", F.lit(1), F.col("l2")), F.slice("head", F.lit(501), F.col("l3")))
    return c.select("cls", F.slice(F.array_compact(parts), 1, size).alias("own"))


def cold_candidates(users: DataFrame, popular: DataFrame, n_popular: DataFrame | int, size: int = 300) -> DataFrame:
    """For users without much history: a stretch of the popularity list that depends on the user, wrapping round; repeats stay.

    n_popular: the length of the popularity list, or one row (n) with it. The stretch depends on user_id % 50 only: fifty
    lists are made and broadcast.
    """
    lists = cold_classes(popular, n_popular, size)
    return unlisted(users.withColumn("cls", F.pmod("user_id", F.lit(50))).join(F.broadcast(lists), "cls").select("user_id", "own"))


def warm_or_cold(users: DataFrame, warm: DataFrame, classes: DataFrame) -> DataFrame:
    """(user_id, item_id, pos): each user's warm list (user_id, own), or, without one, the cold list of their class; an item once, at its first place.

    The lists meet their users where these lie, so the candidates lie by user and nothing of them has moved. Warm lists hold an item once.
    """
    entries = lambda c: F.transform(c, lambda x, i: F.struct((i + 1).cast("int").alias("pos"), x.alias("item_id")))
    first = F.filter(entries("own"), lambda x: F.array_position("own", x["item_id"]) == x["pos"])
    cold = classes.select("cls", first.alias("cold"))
    every = users.join(warm.select("user_id", entries("own").alias("warm")), "user_id", "left").withColumn("cls", F.pmod("user_id", F.lit(50))).join(F.broadcast(cold), "cls", "left")
    return every.select("user_id", F.explode(F.coalesce("warm", "cold")).alias("x")).select("user_id", "x.item_id", "x.pos")


def warm_candidates(users: DataFrame, history: DataFrame, neighbours: DataFrame, item_category: DataFrame, category_list: DataFrame, popular: DataFrame, size: int = 300) -> DataFrame:
    """The lists of warm_listed as (user_id, item_id, pos)."""
    return unlisted(warm_listed(users, history, neighbours, item_category, category_list, popular, size))


def warm_listed(users: DataFrame, history: DataFrame, neighbours: DataFrame, item_category: DataFrame, category_list: DataFrame, popular: DataFrame, size: int = 300) -> DataFrame:
    """(user_id, own): history, then co-purchase neighbours, then items of its categories, then two stretches of the popularity list.

    history: (user_id, item_id, pos); neighbours: (item_id, nbr_id, rank); category_list: (catalogid, item_id, nth).
    Each category gives its first ten items once: a later history item of it would add none of the others. Only items of the
    catalogue count: the lists are cut to it before any user meets them.
    """
    known = item_category.select("item_id")
    popular = popular.join(known, "item_id", "left_semi")
    category_list = category_list.filter("nth <= 10").join(known, "item_id", "left_semi")
    own = history.join(users.select("user_id"), "user_id", "left_semi").join(known, "item_id", "left_semi")
    a = own.filter("pos <= 30").select("user_id", "item_id", F.lit(0).alias("prio"), F.col("pos").alias("p1"), F.lit(0).alias("p2"))
    near = neighbours.filter("rank <= 8").join(known.withColumnRenamed("item_id", "nbr_id"), "nbr_id", "left_semi")
    b = own.filter("pos <= 15").join(near, "item_id").select("user_id", F.col("nbr_id").alias("item_id"), F.lit(1).alias("prio"), F.col("pos").alias("p1"), F.col("rank").alias("p2"))
    cats = own.filter("pos <= 20").join(item_category, "item_id").filter("catalogid IS NOT NULL AND catalogid <> 0").groupBy("user_id", "catalogid").agg(F.min("pos").alias("p1"))
    c = cats.join(category_list, "catalogid").select("user_id", "item_id", F.lit(2).alias("prio"), "p1", F.col("nth").alias("p2"))
    first = first_occurrences(a.unionByName(b).unionByName(c), ["prio", "p1", "p2"], size)
    # ranks from 50 + at most 99 on for half of the places, and from 200 + at most 149 on for all of them
    u = users.select("user_id").distinct().join(listed(first), "user_id", "left").crossJoin(F.broadcast(head_of(popular, 349 + size)))
    u = u.withColumn("own", F.coalesce("own", F.expr("slice(head, 1, 0)"))).withColumn("needed", F.lit(size) - F.size("own"))
    stretches = [F.slice("head", (F.lit(s + 1) + F.col("user_id") % m).cast("int"), n) for s, m, n in [(50, 100, F.expr("needed div 2").cast("int")), (200, 150, F.col("needed"))]]
    every = F.array_distinct(F.concat("own", *[F.array_compact(s) for s in stretches]))
    return u.select("user_id", F.slice(every, 1, size).alias("own"))


def legacy_candidates(history: DataFrame, neighbours: DataFrame, item_category: DataFrame, category_list: DataFrame, popular: DataFrame, users: DataFrame, cap: int = 300) -> DataFrame:
    """Set union of 30 recent items, 15 neighbours of ten of them, 15 items of the categories of five, five popular ones; the most popular stay."""
    own = history.join(users.select("user_id"), "user_id", "left_semi")
    # every item has its rank before a user meets it: the candidates move once, to their users
    rank = lambda df, c="item_id": df.join(popular.select(F.col("item_id").alias(c), "pop_rank"), c, "left")
    near = own.filter("pos <= 10").join(rank(neighbours.filter("rank <= 15"), "nbr_id"), "item_id").select("user_id", F.col("nbr_id").alias("item_id"), "pop_rank")
    cats = own.filter("pos <= 5").join(item_category, "item_id").select("user_id", "catalogid").distinct().join(rank(category_list.filter("nth <= 15").select("catalogid", "item_id")), "catalogid").select("user_id", "item_id", "pop_rank")
    top = users.select("user_id").crossJoin(F.broadcast(popular.filter("pop_rank < 5").select("item_id", "pop_rank")))
    every = rank(own.filter("pos <= 30").select("user_id", "item_id")).select("user_id", "item_id", "pop_rank").unionByName(near).unionByName(cats).unionByName(top)
    once = every.repartition("user_id").groupBy("user_id", "item_id").agg(F.coalesce(F.min("pop_rank"), F.lit(1000000000)).alias("pop_rank"))
    return top_per_group(once, ["user_id"], [F.asc("pop_rank"), F.asc("item_id")], cap, "pos").select("user_id", "item_id", "pos")


def truncate_by_popularity(candidates: DataFrame, popular: DataFrame, cap: int) -> DataFrame:
    """A user's cap most popular candidates; items without a rank come last."""
    with_rank = candidates.join(popular.select("item_id", "pop_rank"), "item_id", "left").withColumn("pop_rank", F.coalesce("pop_rank", F.lit(1000000000)))
    return top_per_group(with_rank, ["user_id"], [F.asc("pop_rank"), F.asc("item_id")], cap, "pos").select("user_id", "item_id", "pos")


def related_items(items: DataFrame, n: int = 3) -> DataFrame:
    """The first n other items of an item's category: an item meets the n + 1 first of it only."""
    first = top_per_group(items.select("item_id", "catalogid"), ["catalogid"], [F.asc("item_id")], n + 1, "nth").withColumnRenamed("item_id", "related_id")
    met = items.select("item_id", "catalogid").join(first, "catalogid").filter("item_id <> related_id")
    return top_per_group(met, ["item_id"], [F.asc("related_id")], n).select("item_id", "related_id", "rank")


def heuristic_recs(weights: DataFrame, related: DataFrame, users: DataFrame, popular: DataFrame, k: int = 100) -> DataFrame:
    """A user's heaviest items, each item's related items in that order, popular items."""
    own = top_per_group(weights.join(users.select("user_id"), "user_id", "left_semi"), ["user_id"], [F.desc("weight"), F.asc("item_id")], k, "at")
    a = own.select("user_id", "item_id", F.lit(0).alias("prio"), F.col("at").alias("p1"), F.lit(0).alias("p2"))
    b = own.join(related, "item_id").select("user_id", F.col("related_id").alias("item_id"), F.lit(1).alias("prio"), F.col("at").alias("p1"), F.col("rank").alias("p2"))
    return fill_up(first_occurrences(a.unionByName(b), ["prio", "p1", "p2"], k), users, popular, k)


def preferences(delivered: DataFrame, views: DataFrame, n: int = 50) -> DataFrame:
    """Bought items and the first n that were viewed."""
    first = top_per_group(views.groupBy("user_id", "item_id").agg(F.min("timestamp").alias("t")), ["user_id"], [F.asc("t"), F.asc("item_id")], n)
    return delivered.select("user_id", "item_id").unionByName(first.select("user_id", "item_id")).distinct()


def unseen_popular(users: DataFrame, popular: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The k most popular items that a user hasn't seen. popular is a bounded list.

    What a user has seen of the list is one array, and the rest of the list is the user's: the product of users and list never moves.
    """
    top = popular.select("item_id", "pop_rank")
    head = top.agg(F.array_sort(F.collect_list(F.struct("pop_rank", "item_id"))).getField("item_id").alias("head"))
    own = seen.select("user_id", "item_id").join(F.broadcast(top.select("item_id")), "item_id", "left_semi").groupBy("user_id").agg(F.collect_set("item_id").alias("own"))
    every = users.select("user_id").join(own, "user_id", "left").crossJoin(F.broadcast(head))
    free = every.select("user_id", F.slice(F.array_except("head", F.coalesce("own", F.expr("slice(head, 1, 0)"))), 1, k).alias("own"))
    return unlisted(free).select("user_id", "item_id", F.col("pos").alias("rank"))


def repeat_to(lists: DataFrame, k: int, users: DataFrame | None = None, popular: DataFrame | None = None) -> DataFrame:
    """Lists repeated from their start until they have k items; users without a list get the popular ones."""
    if users is not None:
        empty = users.select("user_id").join(lists.select("user_id").distinct(), "user_id", "left_anti")
        lists = lists.select("user_id", "item_id", "pos").unionByName(empty.crossJoin(F.broadcast(popular.filter(F.col("pop_rank") < k).select("item_id", (F.col("pop_rank") + 1).alias("pos")))))
    whole = lists.withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    times = whole.withColumn("at", F.explode(F.expr(f"sequence(pos, greatest({k}, pos), n)")))
    return times.filter(F.col("at") <= k).select("user_id", F.col("at").cast("int").alias("pos"), "item_id")


def long_tail(items: DataFrame, popular: DataFrame, head: int = 500) -> DataFrame:
    return items.select("item_id").join(F.broadcast(popular.filter(F.col("pop_rank") < head).select("item_id")), "item_id", "left_anti")


#: What the arithmetic hash that stands in for chance is taken modulo, and the multipliers of items and users.
RING, ITEM_STEP, USER_STEP, USER_CLASSES = 1000003, 7919, 104729, 1000


def spread_sample(users: DataFrame, items: DataFrame, n: int, not_of: DataFrame | None = None) -> DataFrame:
    """n items a user by an arithmetic hash that stands in for chance; not_of (user_id, item_id): what a user may not have.

    The hash is a shift by user modulo a constant, so the items are a ring in the order of their own hash and a user takes the first n from
    their place on. Items get their places from range partitions and offsets, and so do the shifts, of which there are a thousand:
    their stretches are lists that are asked for by place. Users whose barred items left less than n ask again for longer ones; only they do.
    """
    hashed = items.select("item_id", F.pmod(F.col("item_id") * ITEM_STEP, F.lit(RING)).alias("h")).distinct()
    shift = F.pmod((F.col("user_id") % USER_CLASSES) * USER_STEP, F.lit(RING))
    marks = users.select(shift.alias("shift")).distinct().select(F.pmod(-F.col("shift"), F.lit(RING)).alias("h"), F.lit(None).cast("long").alias("item_id"), "shift")
    both = hashed.select("h", "item_id", F.lit(None).cast("long").alias("shift")).unionByName(marks.select("h", "item_id", F.col("shift").cast("long").alias("shift")))
    placed = numbered(both, [F.asc("h"), F.asc_nulls_first("item_id"), F.asc("shift")], "place", F.col("item_id").isNotNull())
    ring, starts = placed.filter("item_id IS NOT NULL").select("item_id", "place"), placed.filter("item_id IS NULL").select("shift", F.col("place").alias("start"))
    total = ring.agg(F.count("*").alias("total"))
    left = users.select("user_id", shift.cast("long").alias("shift")).distinct()

    def asked(length: int, first: int) -> DataFrame:
        """(shift, items): the ring's items from the first-th on of each shift, with their places."""
        s = starts.join(left.select("shift").distinct(), "shift", "left_semi") if first else starts
        s = s.crossJoin(F.broadcast(total)).filter(F.col("total") > first).select("shift", "start", "total", F.explode(F.sequence(F.lit(first), F.least(F.lit(length), F.col("total")).cast("int") - 1)).alias("nth"))
        met = s.withColumn("place", (F.col("start") + F.col("nth")) % F.col("total")).join(ring, "place")
        return met.groupBy("shift").agg(F.array_sort(F.collect_list(F.struct("nth", "item_id"))).alias("items"))

    def taken(length: int) -> DataFrame:
        lists = left.join(F.broadcast(asked(length, 0)), "shift")  # a thousand lists at most
        rows = lists.select("user_id", F.explode("items").alias("x")).select("user_id", "x.item_id", "x.nth")
        return rows if not_of is None else rows.join(not_of.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")

    if not_of is None:
        return taken(n).select("user_id", "item_id", (F.col("nth") + 1).cast("int").alias("rank"))
    out, length, size = None, 2 * n, total.first()[0]
    while True:
        found = top_per_group(taken(length), ["user_id"], [F.asc("nth")], n).select("user_id", "item_id", "rank")
        if length >= size:
            return found if out is None else out.unionByName(found)
        full = found.filter(F.col("rank") == n).select("user_id").persist()
        some = found.join(full, "user_id", "left_semi")
        out = some if out is None else out.unionByName(some)
        left = left.join(full, "user_id", "left_anti").persist()
        if left.isEmpty():
            return out
        length *= 8


def explore(recs: DataFrame, fresh: DataFrame, k: int, most: int = 10) -> DataFrame:
    """Up to most fresh items take the last places of the lists; what a list has already is not fresh. A list is an array: it moves once."""
    part = lambda c: F.array_sort(F.collect_list(F.when(c, F.struct("pos", "item_id")))).getField("item_id")
    old = recs.groupBy("user_id").agg(part(F.col("pos") <= k - most).alias("ahead"), part(F.col("pos") > k - most).alias("behind"))
    new = listed(fresh.filter(F.col("rank") <= most).select("user_id", "item_id", F.col("rank").alias("pos"))).withColumnRenamed("own", "new")
    # a user may be in one of them only
    own = old.join(new, "user_id", "full").select("user_id", *[F.coalesce(c, F.slice(other, 1, 0)).alias(c) for c, other in (("ahead", "new"), ("behind", "new"), ("new", "ahead"))])
    every = F.concat("ahead", F.array_except("new", F.concat("ahead", "behind")), "behind")
    return unlisted(own.select("user_id", F.slice(F.array_distinct(every), 1, k).alias("own")))


def segment_popular(users: DataFrame, popular: DataFrame, n_popular: DataFrame | int, length: int = 100, segments: int = 20) -> DataFrame:
    """The popular items from the start of the user's segment on. n_popular: the length of the popularity list, or one row (n) with it."""
    c = _with_length(users.sparkSession.range(segments).select(F.col("id").alias("cls")), n_popular)
    lists = stretches(c.select("cls", (F.col("cls") * F.expr(f"n div {segments}")).cast("int").alias("s"), F.lit(length).alias("n")), popular)
    return unlisted(users.withColumn("cls", F.pmod("user_id", F.lit(segments))).join(F.broadcast(lists), "cls").select("user_id", F.col("items").alias("own")))


def similar_users(lists: DataFrame, least: int = 5, part: int = 64, first: int = 8) -> DataFrame:
    """Of each user the least other user that shares at least so many items, for lists of any length.

    Two lists that share so many items share one of the first size - least + 1 of either, rarest first: users meet by these items only. Equal
    lists are one. Of the lists that share a key (one item at first) in groups of up to `part` all are compared, and these
    pairs never leave their group. In a larger group all lists are compared with the `first` least users of it: who is like one of them has
    the least of this group. Only the others go on, to keys of one item more, and meet those that have this key as well; lists that share a
    key of `least` items are alike without being compared. So no group of any size becomes all of its pairs.
    """
    once = lists.select("user_id", "item_id").distinct()
    known = once.groupBy("item_id").agg(F.count("*").alias("n")).filter("n > 1")
    sets = once.join(known, "item_id").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("n", "item_id"))).getField("item_id").alias("items")).filter(F.size("items") >= least)
    sets = sets.persist()
    classes = sets.groupBy("items").agg(F.min("user_id").alias("rep")).select("rep", "items")
    classes = stage(classes, "lists")
    members = classes.select("rep", "items", F.lit(True).alias("asks"), F.posexplode(F.slice("items", F.lit(1), F.size("items") - (least - 1))).alias("at", "item_id"))
    members = members.select("rep", "items", "asks", "at", F.array("item_id").alias("key"))
    alike = lambda x: lambda y: (y["rep"] < x["rep"]) & (F.size(F.array_intersect(y["items"], x["items"])) >= least)
    lowest = lambda x: F.array_min(F.transform(F.filter("group", alike(x)), lambda y: y["rep"]))
    found = classes.select("rep", F.lit(None).cast("long").alias("linked"))
    for level in range(1, least + 1):
        if level == least:
            low = members.groupBy("key").agg(F.min("rep").alias("linked"))
            found = found.unionByName(members.filter("asks").join(low, "key").filter("linked < rep").select("rep", "linked"))
            break
        large = members.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > part).select("key").persist()
        together = members.join(large, "key", "left_anti").repartition("key").groupBy("key").agg(F.collect_list(F.struct("rep", "items", "asks")).alias("group"))
        pairs = together.filter(F.size("group") > 1).select("group", F.explode("group").alias("x")).filter("x.asks").select(F.col("x.rep").alias("rep"), lowest(F.col("x")).alias("linked"))
        found = found.unionByName(pairs.filter("linked IS NOT NULL"))
        if large.isEmpty():
            break
        crowd = members.join(large, "key", "left_semi")
        head = top_per_group(crowd.select("key", "rep", "items"), ["key"], [F.asc("rep")], first).groupBy("key").agg(F.collect_list(F.struct("rep", "items")).alias("group"))
        tried = crowd.filter("asks").join(head, "key").select("key", "rep", F.array_max(F.col("group.rep")).alias("upto"), lowest(F.struct("rep", "items")).alias("linked"))
        tried = stage(tried.filter("linked IS NOT NULL OR rep > upto").select("key", "rep", "linked"), "tried")
        found = found.unionByName(tried.filter("linked IS NOT NULL").select("rep", "linked"))
        open_ = tried.filter("linked IS NULL").select("key", "rep").withColumn("open", F.lit(True))
        if open_.isEmpty():
            break
        more = crowd.drop("asks").join(open_.select("key").distinct(), "key", "left_semi").join(open_, ["key", "rep"], "left")
        at = F.posexplode(F.expr(f"slice(items, at + 2, size(items) - {least - level} - at)"))
        more = more.filter(F.col("at") + 1 < F.size("items") - (least - level - 1)).select("rep", "items", F.coalesce("open", F.lit(False)).alias("asks"), F.col("at").alias("before"), "key", at.alias("step", "item_id"))
        more = more.select("rep", "items", "asks", (F.col("before") + 1 + F.col("step")).alias("at"), F.concat("key", F.array("item_id")).alias("key"))
        members = stage(more.join(more.filter("asks").select("key").distinct(), "key", "left_semi"), "members")
    linked = found.groupBy("rep").agg(F.min("linked").alias("linked"))
    users = sets.join(classes, "items").select("user_id", "rep").join(linked, "rep", "left")
    return users.select("user_id", F.least("rep", "linked").alias("other_id")).filter("other_id < user_id")


def same_recents(recents: DataFrame, n: int = 5) -> DataFrame:
    """Of each user the least other user with the same n recent items (of lists of n items: who shares n of them).

    Users meet by their sorted lists as a key; no item gathers its users and no pairs are made.
    """
    lists = recents.groupBy("user_id").agg(F.array_sort(F.collect_set("item_id")).alias("items")).filter(F.size("items") == n)
    least = lists.groupBy("items").agg(F.min("user_id").alias("other_id"))
    return lists.join(least, "items").filter("other_id < user_id").select("user_id", "other_id")


def reuse_lists(recs: DataFrame, similar: DataFrame) -> DataFrame:
    """The lists of users who have a similar user are that user's: similar (user_id, other_id)."""
    taken = recs.withColumnRenamed("user_id", "other_id").join(similar, "other_id").select("user_id", "item_id", "pos")
    return recs.join(similar.select("user_id"), "user_id", "left_anti").select("user_id", "item_id", "pos").unionByName(taken)


def diversify(scored: DataFrame, k: int, per_category: int = 2) -> DataFrame:
    """At most per_category items of a category in the order of scores, then the others; unknown categories are one."""
    rows = scored.withColumn("cat", F.coalesce("catalogid", F.lit(-1)))
    rows = ranked(rows, ["user_id", "cat"], [F.desc("score"), F.asc("item_id")], "in_cat").withColumn("n", F.count("*").over(Window.partitionBy("user_id")))
    later = F.when((F.col("in_cat") > per_category) & (F.col("n") > k), 1).otherwise(0)
    return ranked(rows.withColumn("later", later), ["user_id"], [F.asc("later"), F.desc("score"), F.asc("item_id")], "pos").filter(F.col("pos") <= k).select("user_id", "item_id", "pos")


def final_ranking(scored: DataFrame, users: DataFrame, popular: DataFrame, k: int = 100) -> DataFrame:
    """Best scores, then earlier candidates; filled from the user's own place in the popularity list, at last from its start even if twice.

    Places lie within the first k + 198 ranks, which are one row: a user's list is filled as an array, and nothing but the scores moves. A
    score that is null or NaN comes after all others.
    """
    last = F.when(F.isnan(F.col("score").cast("double")), None).otherwise(F.col("score"))
    best = top_per_group(scored, ["user_id"], [F.desc_nulls_last(last), F.asc("pos"), F.asc("item_id")], k, "at").select("user_id", "item_id", F.col("at").alias("pos"))
    every = users.select("user_id", F.lit(True).alias("open")).distinct().join(listed(best), "user_id", "full").crossJoin(F.broadcast(head_of(popular, k + 198)))
    own = F.coalesce("own", F.expr("slice(head, 1, 0)"))
    ahead = F.array_except(F.array_compact(F.slice("head", (F.pmod("user_id", F.lit(100)) * 2 + 1).cast("int"), F.lit(k))), own)
    both = F.concat(own, F.slice(ahead, F.lit(1), F.greatest(F.lit(k) - F.size(own), F.lit(0))))
    filled = every.select("user_id", "open", "head", own.alias("own"), both.alias("both"))
    again = F.array_compact(F.slice("head", F.lit(1), F.greatest(F.lit(k) - F.size("both"), F.lit(0))))
    return unlisted(filled.select("user_id", F.when(F.col("open"), F.concat("both", again)).otherwise(F.col("own")).alias("own")))


def negatives(positives: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """n items a user that are none of theirs."""
    return spread_sample(positives.select("user_id").distinct(), items, n, positives.distinct())
