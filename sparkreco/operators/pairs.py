"""A stored table of features of (user, item) pairs, bucketed by the pair: lookups move the pairs that are asked for and nothing of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEYS = ("user_id", "item_id")


def store_pairs(features: DataFrame, table: str, folder: str, buckets: int = 64) -> None:
    """Write (user_id, item_id, ...) as a table of the catalogue, sorted within its buckets; an older one of this name is replaced.

    Rows are dealt to the buckets before they are written: a file a bucket. A pair is in one bucket, a user with very many items in all of them.
    """
    spark = features.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    features.repartition(buckets, *KEYS).write.mode("overwrite").bucketBy(buckets, *KEYS).sortBy(*KEYS).option("path", folder).format("parquet").saveAsTable(table)


def look_up(spark: SparkSession, table: str, pairs: DataFrame) -> DataFrame:
    """The stored rows of the pairs, each once; pairs that aren't stored are left out."""
    return spark.table(table).join(pairs.select(*KEYS).distinct(), list(KEYS))
