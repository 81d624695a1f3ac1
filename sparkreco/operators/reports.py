"""Profiles and distributions of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkreco.functions.scalar import micros


def distribution(df: DataFrame, column: str) -> DataFrame:
    total = df.agg(F.count("*").alias("total"))
    return df.groupBy(column).agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select(column, "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"))


def profile(df: DataFrame, ts: str) -> DataFrame:
    at = df.withColumn("__us", micros(ts))
    return at.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("item_id").alias("items"), F.min("__us").alias("first_us"), F.max("__us").alias("last_us"))


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, and how many of them are not null in each column."""
    return df.agg(F.count("*").alias("n"), *[F.count(c).alias(c) for c in columns])


def per_day(df: DataFrame, ts: str) -> DataFrame:
    return df.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, key: str, bins: int = 50) -> DataFrame:
    """How many keys have how many rows, in bins of equal width; the last bin holds its upper edge."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    ends = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("n") - F.col("lo")) / width), F.lit(bins - 1)))
    return counts.crossJoin(F.broadcast(ends)).select(at.cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("keys"))


def quantile_micros(df: DataFrame, ts: str, q: float) -> DataFrame:
    """The interpolated q-quantile of a time: times are counted first, and only days' totals meet in one task."""
    counts = df.select(micros(ts).alias("us")).filter("us IS NOT NULL").groupBy("us").count().withColumn("day", F.expr("us div 86400000000"))
    days = counts.groupBy("day").agg(F.sum("count").alias("n"))
    before = days.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    upto = counts.withColumn("own", F.sum("count").over(Window.partitionBy("day").orderBy("us"))).join(F.broadcast(before), "day").withColumn("upto", F.col("before") + F.col("own"))
    place = (F.col("total") - 1) * F.lit(q)
    low, high = (F.min(F.when(F.col("upto") > f(place), F.col("us"))) for f in (F.floor, F.ceil))
    ends = upto.agg(low.alias("a"), high.alias("b"), F.max(place - F.floor(place)).alias("part"))
    return ends.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("q_us"))


def list_lengths(recs: DataFrame, k: int) -> DataFrame:
    n = recs.groupBy("user_id").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.avg("n"), 6).alias("mean_n"), F.max("n").alias("max_n"), F.min(F.col("n") == k).cast("int").alias("all_k"))


def non_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    any_set = F.greatest(*[F.abs(c) for c in columns]) > 0
    return df.agg(F.count("*").alias("entities"), F.count_if(any_set).alias("with_features"))


def overlap(train: DataFrame, test: DataFrame, ts: str) -> DataFrame:
    """Whether training events end before the test's begin."""
    return train.agg(F.max(micros(ts)).alias("train_last_us")).crossJoin(test.agg(F.min(micros(ts)).alias("test_first_us"))).withColumn("disjoint", (F.col("train_last_us") < F.col("test_first_us")).cast("int"))
