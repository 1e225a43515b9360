"""Synthetic candles: a regime-switching walk from hashed random numbers, the same on every run and cluster."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGIME_BARS = 500
DRIFT, SIGMA = 1.5e-5, 1.8e-4
PAYOUTS = (0.70, 0.75, 0.80, 0.82, 0.85, 0.90, 0.92)


def uniform(seed: int, name: str, *columns: str):
    """A number in (0, 1) from eight hex digits of an MD5."""
    text = F.concat_ws("|", F.lit(f"{seed}|{name}"), *[F.col(c).cast("string") for c in columns])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32


def synthetic_ohlc(spark: SparkSession, rows: int = 20_000, seed: int = 42, seconds: int = 60) -> DataFrame:
    """ts, open, high, low, close, payout; drift flips with the regime, steps are normal."""
    if rows < 1:
        raise ValueError("rows must be positive")
    base = spark.range(rows).withColumn("regime", F.floor(F.col("id") / REGIME_BARS))
    normal = F.sqrt(-2 * F.log(uniform(seed, "a", "id"))) * F.cos(2 * math.pi * uniform(seed, "b", "id"))
    sign = F.element_at(F.array(F.lit(-1.0), F.lit(0.0), F.lit(1.0)), F.floor(uniform(seed, "r", "regime") * 3).cast("int") + 1)
    steps = base.withColumn("step", sign * DRIFT + normal * SIGMA)
    # Sums within a regime, shifted by those of the regimes before, of which there is one row each.
    within = F.sum("step").over(Window.partitionBy("regime").orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    earlier = F.sum("total").over(Window.orderBy("regime").rowsBetween(Window.unboundedPreceding, -1))
    regimes = steps.groupBy("regime").agg(F.sum("step").alias("total")).select("regime", F.coalesce(earlier, F.lit(0.0)).alias("before"))
    steps = steps.withColumn("within", within).join(regimes, "regime")
    out = steps.withColumn("close", F.lit(1.1) + F.col("before") + F.col("within")).withColumn("open", F.col("close") - F.col("step"))
    wick = lambda name: uniform(seed, name, "id") * SIGMA
    pick = F.element_at(F.array(*[F.lit(p) for p in PAYOUTS]), F.floor(uniform(seed, "p", "id") * len(PAYOUTS)).cast("int") + 1)
    start = F.lit("2024-01-01").cast("timestamp")
    return out.select(
        F.timestamp_seconds(F.unix_seconds(start) + F.col("id") * seconds).alias("ts"), "open", (F.greatest("open", "close") + wick("h")).alias("high"),
        (F.least("open", "close") - wick("l")).alias("low"), "close", pick.alias("payout"),
    )
