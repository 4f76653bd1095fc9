"""Tables written once to the cluster's shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder; a temporary folder for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="phrasewell-"))
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/phrasewell-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Tables written by :func:`keep` in this application.
_kept: list[str] = []


def drop_kept(spark: SparkSession) -> None:
    """Delete what :func:`keep` wrote; call when no index or answer that reads it is still needed (saved ones have files of their own)."""
    while _kept:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lost executors don't lose it, and later plans prune its columns."""
    path = new_path(df.sparkSession, name)
    _kept.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, by: str, as_: str) -> DataFrame:
    """``df`` with ``as_``: its 1-based position by the distinct column ``by``, in byte order.

    Sorted by range partitions; only a row count per partition goes through one
    task, so no task sees the whole table as it would with a global window.
    """
    at = keep(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__part", F.spark_partition_id()), f"ranked-{as_}")
    counts = at.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(F.col("__part").alias("__p"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__skip"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(by))
    # One row per partition of the table.
    return at.withColumn("__row", place).join(F.broadcast(before), F.col("__part") == F.col("__p")).withColumn(as_, (F.col("__row") + F.col("__skip")).cast("long")).drop("__part", "__p", "__row", "__skip")
