"""Cutting lineage through the shared folder named in ``spark.checkpoint.dir``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(master: str, named: str | None, warehouse: str) -> str:
    """The folder the cluster names, else one below the warehouse; a warehouse on the driver's own disk will do on one machine only."""
    if named:
        return named
    local = warehouse.startswith("file:") or "://" not in warehouse
    if local and not master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_shared"


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below the one the cluster names in ``spark.checkpoint.dir``; see ``shared_root`` where that is unset (tests, one
    machine). The folder goes when the application ends.
    """
    root = shared_root(spark.sparkContext.master, spark.conf.get("spark.checkpoint.dir", None), spark.conf.get("spark.sql.warehouse.dir"))
    folder = f"{root}/tidemark-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def new_folder(spark: SparkSession) -> str:
    """A folder name in the shared folder that no other table has."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Later branches and retried tasks then read the same rows, and the size of the table is known exactly, so that a
    broadcast can be decided on it.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stable(df: DataFrame) -> None:
    """Delete the files of a table that ``stable`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
