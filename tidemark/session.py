"""A session with the settings the engine relies on, and folders for its intermediate files."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tidemark") -> SparkSession:
    """A cluster's own settings win."""
    return SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a session in one process (tests) may leave it unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_root()


@lru_cache(1)
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, deleted when the application ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs, jpath = file_system(spark, path)
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows from a table written below the shared folder: computed once, and safe from lost executors."""
    path = f"{shared_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop's file system of a path, the path as its object)."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath
