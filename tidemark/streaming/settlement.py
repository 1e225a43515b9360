"""Candidates that a stream settles itself: keyed state holds them until their candles are there, timers give up on those that never come.

Keys are (asset, block of time): a candle goes to the one or two blocks whose candidates it may settle, so that one
asset's history spreads over tasks and a block's state goes when its time has passed. The state is in the state store of the
query's checkpoint; after a restart waiting candidates, candles and timers are as before.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SECOND_US = 1_000_000
OUTPUT = "asset string, candidate_id string, entry_us long, expiry_us long, entry_price double, exit_price double, result string, pnl double"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MISSING = "missing"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started while it lasts keep their state in the store that timers and maps need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Settle(StatefulProcessor):
    """State of one (asset, block): candles, and candidates with what they wait for; both are read and written as lists, once a batch."""

    def __init__(self, period_us: int, block_us: int, horizon_bars: int):
        self.period, self.block, self.horizon = period_us, block_us, horizon_bars

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.candles = handle.getListState("candles", "us bigint, open double, close double")
        self.waiting = handle.getListState("waiting", "id string, signal_us bigint, first int, last int, side int, payout double, done boolean")

    def _end_us(self, block: int) -> int:
        """When no candle that this block may use can come any more."""
        return (block + 1) * self.block + (self.horizon + 1) * self.period

    def _outcome(self, asset: str, row: tuple, prices: dict, final: bool) -> tuple | None:
        """The settlement, if every candle up to the expiry is there; if the last has had its time, a miss."""
        name, signal, first, last, side, payout, _ = row
        times = [signal + k * self.period for k in range(1, last + 1)]
        entry_us, expiry_us = times[first - 1], times[-1]
        if not all(t in prices for t in times):
            return (asset, name, entry_us, expiry_us, None, None, MISSING, None) if final else None
        entry, exit_ = prices[entry_us][0], prices[expiry_us][1]
        move = (exit_ > entry) - (exit_ < entry)
        result = {1: "win", -1: "loss", 0: "tie"}[move * side]
        pnl = {"win": payout, "loss": -1.0, "tie": 0.0}[result]
        return (asset, name, entry_us, expiry_us, entry, exit_, result, pnl)

    def _settle(self, asset: str, waiting: dict, prices: dict, until_us: int | None) -> Iterator[pd.DataFrame]:
        """All that can be settled now, then the new state. until_us: expiries up to here have had their time."""
        out = []
        for name, row in waiting.items():
            if not row[-1]:
                due = until_us is not None and row[1] + (row[3] + 1) * self.period <= until_us
                found = self._outcome(asset, row, prices, due)
                if found:
                    out.append(found)
                    waiting[name] = (*row[:-1], True)
        if waiting:
            self.waiting.put([*waiting.values()])
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def _loaded(self) -> tuple[dict, dict]:
        return {r[0]: tuple(r) for r in self.waiting.get()}, {r[0]: (r[1], r[2]) for r in self.candles.get()}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, prices = self._loaded()
        fresh, timers = [], {self._end_us(key[1])}
        for batch in rows:
            for r in batch.itertuples(index=False):
                if r.candidate_id is None:
                    if r.us not in prices:
                        prices[r.us] = (r.open, r.close)
                        fresh.append((r.us, r.open, r.close))
                elif r.candidate_id not in waiting:
                    waiting[r.candidate_id] = (r.candidate_id, r.us, int(r.first), int(r.last), int(r.side), r.payout, False)
                    timers.add(r.us + (int(r.last) + 1) * self.period)
        if fresh:
            self.candles.appendList(fresh)
        for us in timers:
            self.handle.registerTimer(us // 1000)
        yield from self._settle(key[0], waiting, prices, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting, prices = self._loaded()
        yield from self._settle(key[0], waiting, prices, now)
        if now >= self._end_us(key[1]):
            self.candles.clear()
            self.waiting.clear()

    def close(self) -> None:
        pass


def settle_stream(candidates: DataFrame, candles: DataFrame, period_seconds: int = 60, lateness: str = "5 minutes", horizon_bars: int = 60, block_bars: int = 240, default_payout: float = 0.82) -> DataFrame:
    """Outcomes of a stream of candidates by a stream of candles, each once.

    candidates: candidate_id, asset, signal_timestamp, direction (call, put), expiry_bars, entry_offset_bars, payout (default_payout if null).
    candles: asset, ts (the start of its period), open, close. A candidate is settled when all candles up to its expiry have come, in
    any order; when the watermark passes the end of its expiry candle without them, its result is `missing`. Of repeated candles and candidates the
    first counts. Start the query within keyed_state().
    """
    if block_bars < horizon_bars:
        raise ValueError("block_bars must be at least horizon_bars")
    period = period_seconds * SECOND_US
    block = block_bars * period
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    last = F.col("entry_offset_bars") + F.col("expiry_bars") - 1
    fine = F.when(last.between(1, horizon_bars) & F.col("direction").isin("call", "put"), last).otherwise(F.raise_error(F.lit("a candidate needs a direction and an expiry within horizon_bars")).cast("int"))
    waiting = candidates.select(
        "asset", us("signal_timestamp").alias("us"), F.lit(None).cast("double").alias("open"), F.lit(None).cast("double").alias("close"), "candidate_id",
        F.col("entry_offset_bars").alias("first"), fine.alias("last"), F.when(F.col("direction") == "call", 1).otherwise(-1).alias("side"),
        F.coalesce("payout", F.lit(default_payout)).alias("payout"), F.floor(us("signal_timestamp") / block).alias("block"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    from_block, to_block = F.floor((us("ts") - horizon_bars * period) / block), F.floor((us("ts") - period) / block)
    seen = candles.select(
        "asset", us("ts").alias("us"), "open", "close", none("string").alias("candidate_id"), none("int").alias("first"), none("int").alias("last"), none("int").alias("side"),
        none("double").alias("payout"), F.explode(F.sequence(from_block, to_block)).alias("block"),
    )
    rows = waiting.unionByName(seen).withColumn("at", F.timestamp_micros(F.col("us") + period)).withWatermark("at", lateness)
    out = rows.groupBy("asset", "block").transformWithStateInPandas(Settle(period, block, horizon_bars), OUTPUT, "Append", "EventTime")
    return out.select(
        "asset", "candidate_id", F.timestamp_micros("entry_us").alias("entry_timestamp"), F.timestamp_micros("expiry_us").alias("expiry_timestamp"), "entry_price", "exit_price", "result", "pnl")
