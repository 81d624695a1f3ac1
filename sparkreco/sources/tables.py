"""Readers: recursive, column-pruned Parquet scans, limits and samples, and the retail tables that the operators work on.

The logical tables are orders (user_id, item_id, created_timestamp, last_status), tracker (user_id, item_id, timestamp, action_type),
items (item_id, itemname, fclip_embed, catalogid), categories (catalogid, catalogpath, ids) and test_users (user_id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMAS = {
    "orders": "user_id bigint, item_id bigint, created_timestamp timestamp_ntz, last_status string",
    "tracker": "user_id bigint, item_id bigint, timestamp timestamp_ntz, action_type string",
    "items": "item_id bigint, itemname string, fclip_embed array<float>, catalogid int",
    "categories": "catalogid int, catalogpath string, ids array<int>",
    "test_users": "user_id bigint",
}


def parquet_files(spark: SparkSession, folder: str) -> list[str]:
    """All Parquet files below a folder, sorted; by Spark's own file system layer, so any store will do."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path")
    return sorted(r["path"] for r in found.collect())


def load(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None, max_files: int | None = None) -> DataFrame:
    """A logical table with its schema, pruned to columns, of the first max_files files."""
    schema = SCHEMAS[name]
    paths = parquet_files(spark, folder)[:max_files] if max_files else [folder]
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
    return df.select(*columns) if columns else df


def load_optional(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """As load, an empty frame if nothing is there."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMAS[name])
    return load(spark, folder, name)


def concat(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name of parts with the same meaning; without parts an error."""
    if not frames:
        raise FileNotFoundError("no input to concatenate")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def bernoulli_sample(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """About rows rows, each by chance."""
    n = df.count()
    return df if n <= rows else df.sample(rows / n, seed=seed)


def first_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows in the order of keys."""
    return df.orderBy(*keys).limit(n)


def rows_between(df: DataFrame, start: int, n: int, *keys: str) -> DataFrame:
    """n rows from the start-th on, in the order of keys."""
    return df.orderBy(*keys).offset(start).limit(n)


def distinct_users(*frames: DataFrame) -> DataFrame:
    """Users of all frames, once each."""
    return concat([f.select("user_id") for f in frames]).distinct()


def check_id_type(df: DataFrame, column: str = "item_id") -> DataFrame:
    """df, if its ids are whole numbers; else an error."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{column} must be of an integral type, not {kind.simpleString()}")
    return df


class Retail:
    """The logical tables derived from a star schema: order lines are orders, events are the tracker, parts are items."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def orders(self) -> DataFrame:
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        heads = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        # six years of orders are laid over the month that the events cover
        when = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, datediff(o_orderdate, DATE'1995-01-01') * 1077)")
        status = F.when(F.col("o_orderstatus") == "F", "delivered_orders").when(F.col("o_orderstatus") == "P", "canceled_orders").otherwise("other")
        return lines.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), when.alias("created_timestamp"), status.alias("last_status"))

    @property
    def tracker(self) -> DataFrame:
        action = F.create_map(*[F.lit(x) for pair in (("view", "page_view"), ("click", "favorite"), ("purchase", "to_cart"), ("signup", "view_description")) for x in pair])
        return self.table("events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), F.col("ts").alias("timestamp"), F.coalesce(action[F.col("event_type")], F.lit("other")).alias("action_type"))

    @property
    def items(self) -> DataFrame:
        parts = self.table("part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("itemname"), F.substring("p_brand", 7, 9).cast("int").alias("catalogid"))
        vectors = self.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("fclip_embed"))
        return parts.join(vectors, "item_id", "left").select("item_id", "itemname", "fclip_embed", "catalogid")

    @property
    def categories(self) -> DataFrame:
        ids = "CASE WHEN b > 5 THEN array(r, (b - 1) div 5 + 1, 200 + b, 300 + b, b) ELSE array(r, b) END"
        brands = self.table("part").select(F.substring("p_brand", 7, 9).cast("int").alias("b")).distinct()
        roots = brands.withColumn("r", F.expr("CASE b % 4 WHEN 0 THEN 7500 WHEN 1 THEN 7697 WHEN 2 THEN 17777 ELSE 999 END"))
        listed = roots.select(F.col("b").alias("catalogid"), F.expr(f"transform({ids}, x -> cast(x as int))").alias("ids"))
        return listed.select("catalogid", F.array_join(F.col("ids").cast("array<string>"), "/").alias("catalogpath"), "ids")

    @property
    def test_users(self) -> DataFrame:
        users = self.table("customer").select(F.col("c_custkey").alias("user_id"))
        return users.unionByName(users.filter("user_id % 50 = 0").select((F.lit(1000000) + F.col("user_id")).cast("bigint").alias("user_id")))
