"""Tables in the folder that the driver and all executors share.

Writing a table cuts the lineage and survives a lost executor. The folder is the one in
``spark.checkpoint.dir``; only where that is unset (local tests) one of our own is set.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lexmill-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def save(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df and returns it as read back, with its path. Numbers of files follow the tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any longer."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: Ids (8 bytes each) that are sent to every task to filter a table by; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df whose doc_id isn't in ids (one column, doc_id). Rows with null doc_id stay."""
    ids, _ = save(ids.where("doc_id is not null").distinct(), "dropped")
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(*df.columns)


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished work, which it does once the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(spark: SparkSession) -> int:
    """Number of shuffle partitions for exchanges that are asked for by number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
