"""Bars: from ticks to candles, numbered bars, time buckets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.schemas import KEYS, PRICES


def series():
    """A series' slice in the order of time."""
    return Window.partitionBy(*KEYS).orderBy("ts")


def back(n: int) -> object:
    """The n rows up to and with the current one."""
    return series().rowsBetween(-(n - 1), 0)


def prior(n: int) -> object:
    """The n rows before the current one."""
    return series().rowsBetween(-n, -1)


def bucket(ts: str, width: str) -> Column:
    """Start of the left-closed time bucket."""
    return F.window(ts, width)["start"]


def ticks_to_candles(ticks: DataFrame, width: str = "1 minute", price: str = "mid", by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Candles from (ts, ask, bid, ask_volume, bid_volume); empty buckets yield none.

    First and last are by time, then by price, so equal timestamps give one defined result.
    Partial aggregates come before the shuffle: a busy bucket costs a row per map task.
    """
    if price not in ("mid", "bid", "ask"):
        raise ValueError("price must be mid, bid or ask")
    value = {"mid": (F.col("ask") + F.col("bid")) / 2, "bid": F.col("bid"), "ask": F.col("ask")}[price]
    rows = ticks.withColumn("px", value)
    at = F.struct("ts", "px")
    out = rows.groupBy(*by, F.window("ts", width).alias("bucket")).agg(
        F.min(at)["px"].alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max(at)["px"].alias("close"),
        F.sum(F.col("ask_volume") + F.col("bid_volume")).alias("volume"), F.avg(F.col("ask") - F.col("bid")).alias("spread_mean"),
    )
    return out.select(*by, F.col("bucket.start").alias("ts"), *PRICES, "volume", "spread_mean")


def require_columns(df: DataFrame, names) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def numbered(bars: DataFrame) -> DataFrame:
    """Bars with series_id, slice and bar_idx (from 0 within the slice)."""
    for name, value in (("series_id", "ALL"), ("slice", "all")):
        bars = bars if name in bars.columns else bars.withColumn(name, F.lit(value))
    return bars.withColumn("bar_idx", F.row_number().over(series()).cast("long") - 1)


def with_interval(bars: DataFrame) -> DataFrame:
    """Add step_us, the time since the bar before, and interval_us, the slice's most frequent positive step, the smallest of equals.

    All windows lie within a slice, so bars are shuffled once.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = bars.withColumn("step_us", us - F.lag(us).over(series()))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "step_us")))
    best = F.max(F.when(F.col("step_us") > 0, F.struct("_n", (-F.col("step_us")).alias("step")))).over(Window.partitionBy(*KEYS))
    return rows.withColumn("interval_us", -best["step"]).drop("_n")


def inferred_interval(bars: DataFrame) -> DataFrame:
    """(series_id, slice, interval_us) of slices that have a positive step."""
    return with_interval(bars).filter("interval_us IS NOT NULL").groupBy(*KEYS).agg(F.first("interval_us").alias("interval_us"))


def with_breaks(bars: DataFrame) -> DataFrame:
    """Add `breaks`, the number of steps so far that differ from the slice's interval.

    Bars i and j are joined by equal steps exactly if breaks are equal at both; with no
    interval (one bar) every bar is alone.
    """
    off = F.coalesce(F.when(F.col("step_us").isNull(), 0).when(F.col("step_us") == F.col("interval_us"), 0), F.lit(1))
    return with_interval(bars).withColumn("breaks", F.sum(off).over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("step_us", "interval_us")


def contiguous_ahead(bars: int) -> Column:
    """Whether the next `bars` steps exist and have the slice's interval; needs with_breaks."""
    return F.coalesce(F.lead("breaks", bars).over(series()) == F.col("breaks"), F.lit(False))


def normalize_symbol(symbol: str) -> str:
    """Upper case with separators removed; six letters."""
    out = re.sub(r"[/_\-\s]", "", symbol.upper())
    if len(out) != 6 or not out.isalpha():
        raise ValueError(f"unsupported symbol {symbol!r}")
    return out


def price_divisor(symbol: str) -> float:
    """Points per unit of price in tick records."""
    return 1e3 if normalize_symbol(symbol).endswith("JPY") else 1e5
