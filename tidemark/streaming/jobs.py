"""Structured Streaming forms of the bar, snapshot and scoring operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.bars import ticks_to_candles
from tidemark.schemas import PRICES


def stream_candles(ticks: DataFrame, width: str = "1 minute", lateness: str = "5 minutes", price: str = "mid", by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Candles of a tick stream; a bucket is final once the watermark has passed it, later ticks are dropped."""
    return ticks_to_candles(ticks.withWatermark("ts", lateness), width, price, by)


def stream_snapshots(candles: DataFrame, lateness: str = "1 hour", keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Overlapping snapshots merged: one row a candle when the watermark has passed it, `conflict` where prices differed."""
    differ = F.lit(False)
    for c in PRICES:
        differ = differ | (F.col(f"lo_{c}") != F.col(f"hi_{c}"))
    rows = candles.withWatermark("ts", lateness).groupBy(*keys, "ts").agg(
        *[F.min(c).alias(f"lo_{c}") for c in PRICES], *[F.max(c).alias(f"hi_{c}") for c in PRICES], F.count(F.lit(1)).alias("copies"))
    return rows.select(*keys, "ts", *[F.col(f"lo_{c}").alias(c) for c in PRICES], differ.alias("conflict"), "copies")


def first_seen(candles: DataFrame, lateness: str = "1 hour", keys: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """Each candle once, as soon as it comes; its repeats within the watermark are dropped."""
    return candles.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(list(keys))


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now into Parquet, exactly once across restarts."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def catch_up(stream: DataFrame, path: str, checkpoint: str) -> None:
    """As drain(), with the batches without rows that give what the last watermark closed; sources in Python get those only here."""
    running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()


def poll_cycles(hours: float, interval_seconds: float) -> int:
    """Cycles of a bounded observer."""
    if interval_seconds < 10 or hours <= 0:
        raise ValueError("interval must be >= 10 seconds and hours positive")
    return max(1, -int(-hours * 3600 // interval_seconds))


def score_stream(candles: DataFrame, decide: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "10 seconds") -> StreamingQuery:
    """Hand each micro-batch of candles to `decide` (for example scoring, then a ledger append); batch ids repeat on recovery."""
    return candles.writeStream.foreachBatch(decide).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
