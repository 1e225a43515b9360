"""Shared pieces: the work folder, finished-step tables, and size-checked joins."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import file_system, shared_folder

#: Separators of words: space and the ASCII controls 0x09 to 0x0D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 10_000


#: Bytes of an Arrow batch that goes to a Python worker, unless the session sets its own bound.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Texts are long: where the session has Spark's default bound of 64 MB a batch, take BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, f"{BATCH_BYTES}b")


class Workspace:
    """Tables of finished steps, below the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks of the current step only.
    Steps that are no longer read are deleted by drop(); what the returned DataFrame still
    reads stays until the application ends, when its file system client deletes the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.path = shared_folder(spark, name)

    def write(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        df.write.option("compression", codec).parquet(f"{self.path}/{name}")
        release(self.spark)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def write_bucketed(self, df: DataFrame, name: str, buckets: int, *keys: str) -> DataFrame:
        """A table bucketed and sorted by its keys, which later joins on them read without a shuffle.

        The catalog forgets it at once; the DataFrame keeps its files and buckets.
        """
        table = f"{name}_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.path}/{name}").saveAsTable(table)
        release(self.spark)
        out = self.spark.table(table)
        self.spark.sql(f"DROP TABLE {table}")
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


def delete(spark: SparkSession, path: str) -> None:
    fs, jpath = file_system(spark, path)
    fs.delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = file_system(spark, path)
    return fs.exists(jpath)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps before the next step adds its own."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def join_checked(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join, null keys equal, broadcasting `small` only if its counted rows are within BROADCAST_ROWS.

    Beyond that it is a sort-merge join, whose hot partitions adaptive execution splits.
    """
    small = small.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in small.columns])
    on: Column = F.lit(True)
    for c in keys:
        on = on & big[c].eqNullSafe(small[f"__{c}"])
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return big.join(F.broadcast(small) if few else small.hint("merge"), on, how).drop(*[f"__{c}" for c in keys])


def splits(df: DataFrame) -> int:
    """Input splits: grows with the stored bytes, so partition counts derived from it do too."""
    return max(1, df.rdd.getNumPartitions())


def by_bytes(batches, column: str, most: int = 1 << 21):
    """Arrow batches cut so that a column holds about `most` bytes (one row at least): bounds a worker's memory."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < b.num_rows:
            before = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, before + most, "right")))
            yield b.slice(start, stop - start)
            start = stop


def lean(run):
    """A function for mapInArrow after whose tasks the reused Python worker keeps no tables and no freed memory."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    from tidemark.llm import hashing

    hashing.powers.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what was freed until asked
    if trim:
        trim(0)


def free_name(columns: list[str], name: str) -> str:
    """A column name that the caller's columns do not use."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name
