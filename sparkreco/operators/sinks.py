"""Sinks: Parquet tables, submissions, artifact folders."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: For tables of rows of a MB or so: by default a writer looks at its memory after 100 rows only, and row groups of 128 MB are what a reader holds at once.
ROWS_OF_MB = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1"}


def write_table(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int | None = None, group_bytes: int | None = None) -> None:
    """mode ignore: leave what is there. group_bytes: of a row group."""
    writer = df.write.mode(mode)
    writer = writer.option("parquet.block.size", group_bytes) if group_bytes else writer
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder that spark.checkpoint.dir names, and read back: later plans start from the files.

    The files go when the session's Python process ends; staged() frees them earlier.
    """
    return staged(df, name)[0]


def staged(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, Callable[[], None]]:
    """As stage(), and what deletes the files, for after their last read. options: of the Parquet writer.

    The files of the shuffles that lead to the table go as soon as it is written: nothing else reads them, and without that they stay on the executors' disks
    until the driver happens to collect its garbage.
    """
    path, spark = scratch(df.sparkSession, name), df.sparkSession
    old = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, old)
    return spark.read.schema(df.schema).parquet(path), lambda: _free(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in shared storage, deleted when the session's Python process ends.

    Only a local session without the setting spark.checkpoint.dir gets a folder of its own; on a cluster executors would not see each other's.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not folder:
        folder = f"file://{tempfile.mkdtemp(prefix='sparkreco-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED[path] = spark
    return path


_STAGED: dict[str, SparkSession] = {}


def _free(path: str) -> None:
    spark = _STAGED.pop(path, None)
    if spark is not None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@atexit.register
def _free_all() -> None:
    for path in list(_STAGED):
        with contextlib.suppress(Exception):  # the session may have ended: the folder is left to the cluster's own retention
            _free(path)


def submission(recs: DataFrame) -> DataFrame:
    """One row a user, the items joined by blanks in their order."""
    listed = recs.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id"))).alias("l"))
    return listed.select("user_id", F.array_join(F.transform("l", lambda x: x["item_id"].cast("string")), " ").alias("items"))


def write_submission(recs: DataFrame, path: str, k: int = 100) -> None:
    header = " ".join(["item_id_1", "item_id_2", "...", f"item_id_{k}"])
    submission(recs).withColumnRenamed("items", header).write.mode("overwrite").option("header", True).csv(path)
