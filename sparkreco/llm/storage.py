"""Shared storage for intermediate tables.

Lineage is cut with Parquet tables in the folder that the cluster names in spark.checkpoint.dir; only where that is
unset in a local session (tests) is a folder of our own used; a cluster without it is refused. Nothing is kept on an executor's own disk, so a lost executor
costs a re-read and never a result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not found:
        found = f"file://{tempfile.gettempdir()}/sparkreco-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, bucketed_by: str | None = None) -> DataFrame:
    """Write df once and read it back: later jobs start from the files, not from df's lineage.

    bucketed_by: a column by which the files are dealt to as many buckets as there are shuffle partitions; what is grouped by it later
    reads these files without a shuffle of their rows.
    """
    spark, key = df.sparkSession, uuid.uuid4().hex
    path = f"{shared_dir(spark)}/{name}-{key}"
    writer = df.write.option("compression", "zstd")
    _WRITTEN.append((spark, path))
    if bucketed_by is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"{name}_{key}".replace("-", "_")
    writer.bucketBy(max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), bucketed_by).option("path", path).format("parquet").saveAsTable(table)
    _TABLES.append((spark, table))
    return spark.table(table)


@atexit.register
def _clean() -> None:
    for spark, table in _TABLES:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # noqa: BLE001  as below
            continue
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone; the cluster's own retention applies
            continue
