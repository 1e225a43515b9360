import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, settle, validate
from tidemark.operators.bars import contiguous_ahead, with_breaks
from tidemark.operators.settle import Settlement, direction_target

RISING = [(100 + i, 101 + i, 99 + i, 100.5 + i) for i in range(6)]


def flat(n, step=0.0):
    return [(100 + i * step, 200.0, 1.0, 100.0 + i * step) for i in range(n)]


def at(df, bar, value=1):
    return df.withColumn("signal", F.when(F.col("bar_idx") == bar, value).otherwise(0))


def test_one_trade(candles):
    t = settle.settle(at(candles(RISING, payouts=[0.1, 0.91, 0.2, 0.2, 0.2, 0.2]), 0), "signal", Settlement(2, payout=0.8)).collect()
    assert len(t) == 1
    assert (t[0]["entry_idx"], t[0]["exit_idx"], t[0]["entry_price"], t[0]["exit_price"], t[0]["result"], t[0]["pnl"]) == (1, 2, 101.0, 102.5, "win", 0.8)


def test_payout_is_taken_at_entry_and_checked(candles):
    b = at(candles(RISING, payouts=[0.1, 0.91, 0.2, 0.2, 0.2, 0.2]), 0)
    assert settle.settle(b, "signal", Settlement(2, payout_column="payout")).first()["payout"] == 0.91
    assert settle.settle(b, "signal", Settlement(2, payout_column="payout", min_payout=0.95)).count() == 0
    bad = at(candles(RISING, payouts=[0.1, 11.0, 0.2, 0.2, 0.2, 0.2]), 0)
    with pytest.raises(Exception, match="payout"):
        settle.settle(bad, "signal", Settlement(2, payout_column="payout")).collect()
    out_of_reach = at(candles(RISING, payouts=[0.1, 0.1, 0.2, 0.2, 0.2, 11.0]), 5)
    assert settle.settle(out_of_reach, "signal", Settlement(2, payout_column="payout")).count() == 0


def test_signals_are_cut_then_checked(candles):
    b = candles(RISING)
    assert settle.settle(at(b, 0, 1.9), "signal", Settlement(1)).count() == 1
    for bad in (0.5, 2):
        with pytest.raises(Exception, match="signals"):
            settle.settle(at(b, 0, bad), "signal", Settlement(1)).collect()
    assert settle.settle(b.withColumn("signal", F.lit(float("nan"))), "signal", Settlement(1)).count() == 0


@pytest.mark.parametrize("policy,result,pnl", [("refund", "tie", 0.0), ("loss", "loss", -1.0), ("win", "win", 0.82)])
def test_ties(candles, policy, result, pnl):
    t = settle.settle(at(candles(flat(4)), 0), "signal", Settlement(1, tie_policy=policy)).first()
    assert (t["result"], t["pnl"]) == (result, pnl)


def test_gaps_end_horizons(candles):
    minutes = [0, 1, 2, 2883, 2884, 2885]
    b = candles([(*r, m) for r, m in zip(RISING, minutes, strict=True)], start="2024-01-05T21:57:00")
    ok = {r["bar_idx"]: (r["a1"], r["a2"]) for r in with_breaks(b).select("bar_idx", contiguous_ahead(1).alias("a1"), contiguous_ahead(2).alias("a2")).collect()}
    assert [ok[i][0] for i in range(6)] == [True, True, False, True, True, False]
    assert [ok[i][1] for i in range(6)] == [True, False, False, True, False, False]
    every = b.withColumn("signal", F.lit(1))
    assert settle.settle(every, "signal", Settlement(2)).count() == 2
    assert settle.settle(every, "signal", Settlement(2, require_contiguous=False)).count() == 4
    target = {r["bar_idx"]: r["t"] for r in with_breaks(b).select("bar_idx", direction_target(2).alias("t")).collect()}
    assert target[0] == 1.0 and target[1] is None and target[3] == 1.0


def test_overlap_and_cooldown(candles):
    b = candles(flat(12, 1.0)).withColumn("signal", F.lit(1))
    assert settle.settle(b, "signal", Settlement(3)).count() == 9
    assert settle.settle(b, "signal", Settlement(3, allow_overlap=False)).count() == 3
    b = candles(flat(20, 1.0)).withColumn("signal", F.lit(1))
    t = settle.settle(b, "signal", Settlement(2, allow_overlap=False, cooldown_bars=2)).orderBy("entry_idx").collect()
    assert t[0]["entry_idx"] == 2  # before any trade the last end is -1
    assert all(y["entry_idx"] > x["exit_idx"] + 2 for x, y in zip(t, t[1:], strict=False))


def test_metrics_by_hand(spark):
    rows = [(i, r, p, "x") for i, (r, p) in enumerate([("win", 0.8), ("loss", -1.0), ("loss", -1.0), ("win", 0.8)])]
    t = spark.createDataFrame(rows, "entry_ts int, result string, pnl double, g string").withColumn("signal_ts", F.col("entry_ts"))
    for m in (metrics.metrics(t).first(), metrics.metrics(t, ["g"]).first()):
        assert (m["win_rate"], m["total_pnl"], m["max_losing_streak"], m["max_winning_streak"], m["max_drawdown"]) == (0.5, pytest.approx(-0.4), 2, 1, 2.0)
    empty = metrics.metrics(t.limit(0)).first()
    assert (empty["trades"], empty["win_rate"], empty["total_pnl"], empty["max_drawdown"], empty["wilson_low"]) == (0, None, 0.0, 0.0, None)
    assert metrics.by_direction(t.withColumn("direction", F.lit(1)).limit(0)).count() == 0
    sides = {r["side"]: r["trades"] for r in metrics.by_direction(t.withColumn("direction", F.lit(1))).collect()}
    assert sides == {"call": 4, "put": 0}


def test_diagnostics(candles):
    d = validate.diagnose(candles([(*RISING[0], 0), (*RISING[1], 1), (*RISING[2], 3)])).first()
    assert (d["missing_intervals"], d["interval_us"], d["gap_events"], d["weekend_gap_events"]) == (1, 60_000_000, 1, 0)
    d = validate.diagnose(candles([(*RISING[i], m) for i, m in enumerate([0, 1, 2882, 2883])], start="2024-01-05T20:58:00")).first()
    assert (d["gap_events"], d["weekend_gap_events"], d["largest_gap_us"]) == (1, 1, 2881 * 60_000_000)
    with pytest.raises(ValueError, match="duplicate"):
        validate.validate(candles([(*RISING[0], 0), (*RISING[1], 0)]))
    with pytest.raises(ValueError, match="OHLC"):
        validate.validate(candles([(10, 9, 8, 10)]))
    with pytest.raises(ValueError, match="missing"):
        validate.validate(candles([(*RISING[0], 0), (*RISING[1], 1), (*RISING[2], 3)]), allow_gaps=False)
    a, b = candles(RISING), candles(RISING).orderBy(F.desc("ts"))
    assert validate.fingerprint(a).first() == validate.fingerprint(b).first()


def test_gapped_series_hide_no_invalid_one(spark):
    import datetime as dt

    def table(last):
        rows = [(f"s{i:02}", m, *RISING[m % 6]) for i in range(60) for m in (0, 1, 3)] + [("z", m, *p) for m, p in last]
        named = spark.createDataFrame([(s, dt.datetime(2024, 1, 1, 0, m, tzinfo=dt.UTC), *map(float, p)) for s, m, *p in rows], "series_id string, ts timestamp, open double, high double, low double, close double")
        return named.repartition(4, "series_id")

    for last, message in (([(0, RISING[0]), (0, RISING[1])], "z: 1 duplicate"), ([(0, (10, 9, 8, 10))], "z: 1 bars with invalid")):
        with pytest.raises(ValueError, match=message):
            validate.validate(table(last))
    assert validate.validate(table([(0, RISING[0])])).count() == 181
    with pytest.raises(ValueError, match="s00: 1 missing"):
        validate.validate(table([(0, RISING[0])]), allow_gaps=False)
