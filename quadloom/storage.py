"""Reliable intermediate tables, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set a session on one machine gets a folder of its own; a cluster is refused, as executors would not see it."""
    sc = spark.sparkContext
    set_folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not set_folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(set_folder or tempfile.mkdtemp(prefix="quadloom-"))
    return (set_folder or sc.getCheckpointDir()).rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Lineage ends in a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """The rows written once as Parquet and read back; the folder joins paths, for remove()."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, in whatever store they lie."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
