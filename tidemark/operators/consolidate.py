"""Union of overlapping candle snapshots into one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.validate import normalize, validate
from tidemark.schemas import PRICES

POLICIES = ("error", "prefer_first", "prefer_last")


def union_snapshots(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name with the snapshot's ordinal; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [normalize(f).withColumn("snapshot", F.lit(i)) for i, f in enumerate(frames)])


def conflicts(rows: DataFrame, keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Keys whose rows disagree on prices."""
    lows = [(F.min(c) != F.max(c)) | (F.count(c) != F.count(F.lit(1))) & (F.count(c) > 0) for c in PRICES]
    return rows.groupBy(*keys).agg(reduce(lambda a, b: a | b, lows).alias("differ"), F.count(F.lit(1)).alias("n")).filter("differ").drop("differ")


def deduplicate(rows: DataFrame, keys: tuple[str, ...] = ("ts",), keep: str = "first") -> DataFrame:
    """One row a key, of the first or last snapshot."""
    order = F.col("snapshot").asc() if keep == "first" else F.col("snapshot").desc()
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter("_n = 1").drop("_n")


def consolidate(frames: list[DataFrame], policy: str = "error", keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """One validated table; rows that agree are merged, rows that conflict fail or follow the policy."""
    if policy not in POLICIES or not frames:
        raise ValueError(f"need frames and a policy of {POLICIES}")
    rows = union_snapshots(frames)
    if policy == "error":
        found = conflicts(rows, keys).limit(3).collect()
        if found:
            raise ValueError(f"conflicting OHLC at {[r[0] for r in found]}")
    return validate(deduplicate(rows, keys, "last" if policy == "prefer_last" else "first").drop("snapshot"))
