"""Connected components by alternating large and small stars; edges stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkreco.llm.storage import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands its least neighbour (or itself) to its larger neighbours, or to its smaller ones and itself."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = around.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a long, b long) -> (node long, label long): the least node reachable; each node that has an edge to another, once."""
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), name)
    state = None
    while True:
        print_of = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if print_of["n"] == 0 or tuple(print_of) == state:
            break
        state = tuple(print_of)
        now = materialize(_star(_star(now, large=True), large=False), name)
    # now each node but the least of its component has one edge, to that least one
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
