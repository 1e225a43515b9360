import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import ledgers
from tidemark.streaming import jobs
from tidemark.streaming.settlement import keyed_state, settle_stream

T0 = dt.datetime(2024, 1, 1, 10, tzinfo=dt.UTC)
CANDIDATE = "candidate_id string, asset string, signal_timestamp timestamp, direction string, expiry_bars int, entry_offset_bars int, payout double"
CANDLE = "asset string, ts timestamp, open double, close double"


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


class Feed:
    """Files that a stream of candidates and candles picks up, run by run."""

    def __init__(self, spark, root):
        self.spark, self.root = spark, root
        for name, schema in (("candidates", CANDIDATE), ("candles", CANDLE)):
            spark.createDataFrame([], schema).write.parquet(f"{root}/{name}")

    def run(self, candidates=(), candles=()):
        for name, schema, rows in (("candidates", CANDIDATE, candidates), ("candles", CANDLE, candles)):
            if rows:
                self.spark.createDataFrame([*rows], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")
        read = lambda name, schema: self.spark.readStream.schema(schema).parquet(f"{self.root}/{name}")
        with keyed_state(self.spark):
            jobs.drain(settle_stream(read("candidates", CANDIDATE), read("candles", CANDLE), 60, "5 minutes", 30, 60), f"{self.root}/out", f"{self.root}/checkpoint")
        out = self.spark.read.parquet(f"{self.root}/out").collect()
        assert len({r["candidate_id"] for r in out}) == len(out)
        return {r["candidate_id"]: r for r in out}


def candle(minute, open_, close, asset="X"):
    return (asset, at(minute), float(open_), float(close))


def test_candles_settle_and_timers_give_up_across_restarts(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    first = feed.run(
        [("up", "X", at(0), "call", 3, 1, 0.9), ("down", "X", at(0), "put", 1, 2, None), ("other", "Y", at(0), "call", 1, 1, 0.8)],
        [candle(3, 12, 13), candle(1, 10, 11), candle(1, 99, 99)],  # out of order, a repeat
    )
    assert first == {}
    second = feed.run([("up", "X", at(0), "call", 3, 1, 0.9)], [candle(2, 11, 11)])
    assert {k: (r["entry_price"], r["exit_price"], r["result"], r["pnl"]) for k, r in second.items()} == {"up": (10.0, 13.0, "win", 0.9), "down": (11.0, 11.0, "tie", 0.0)}
    assert second["up"]["entry_timestamp"].minute == 1 and second["up"]["expiry_timestamp"].minute == 3
    # Over the edge of a block; the candidate of 58 needs 59, 60 and 61, of which one does not come.
    third = feed.run([("edge", "X", at(57), "put", 2, 1, None), ("gap", "X", at(58), "call", 3, 1, 0.8)], [candle(59, 20, 21), candle(58, 20, 22), candle(61, 21, 25)])
    assert {*third} == {"up", "down", "edge", "other"} and (third["edge"]["result"], third["edge"]["pnl"]) == ("loss", -1.0)
    last = feed.run([], [candle(90, 1, 1)])
    assert (last["gap"]["result"], last["gap"]["exit_price"], last["gap"]["pnl"]) == ("missing", None, None) and last["other"]["result"] == "missing"
    assert feed.run([], [candle(60, 1, 1)]) == last  # too late


def test_wrong_candidates_fail_the_query(spark, tmp_path):
    with pytest.raises(Exception, match="horizon_bars"):
        Feed(spark, str(tmp_path)).run([("far", "X", at(0), "call", 40, 1, 0.9)])
    with pytest.raises(ValueError, match="block_bars"):
        settle_stream(None, None, horizon_bars=60, block_bars=10)


def test_a_batch_that_comes_again_adds_nothing_to_the_ledger(spark, tmp_path):
    path = str(tmp_path / "events")
    made = spark.createDataFrame([("m", "X", "regular", at(i), "call", 0.7, 0.6, 3) for i in range(3)], "model_version string, asset string, market_type string, signal_timestamp timestamp, direction string, probability double, probability_threshold double, expiry_bars int")
    ledgers.append_candidates(made, path)
    known = ledgers.events(spark, path, "candidate").orderBy("signal_timestamp").select("candidate_id", "signal_timestamp")
    settled = known.select("candidate_id", (F.col("signal_timestamp") + F.expr("INTERVAL 1 MINUTE")).alias("entry_timestamp"), (F.col("signal_timestamp") + F.expr("INTERVAL 3 MINUTE")).alias("expiry_timestamp"),
                           F.lit(1.0).alias("entry_price"), F.lit(2.0).alias("exit_price"), F.when(F.minute("signal_timestamp") == 2, "missing").otherwise("win").alias("result"), F.lit(0.8).alias("pnl"))
    for _ in range(2):
        ledgers.append_settled(settled, path)
    assert sorted(r["settled"] for r in ledgers.forward_ledger(spark, path).collect()) == [False, True, True]
    assert ledgers.verify(spark, path)
