import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import context, indicators, signals
from tidemark.operators.stream import ewm
from tidemark.schemas import KEYS


def walk(n, seed=1):
    r, p, out = random.Random(seed), 1.1, []
    for _ in range(n):
        o, c = p, p + r.gauss(0, 2e-4)
        out.append((o, max(o, c) + abs(r.gauss(0, 1e-4)), min(o, c) - abs(r.gauss(0, 1e-4)), c))
        p = c
    return out


def test_ewm_equals_pandas_over_gaps_and_batches(spark, candles):
    xs = [None, 1.0, None, None, 4.0, 2.0, None, 7.0, 1.0, 3.0] * 30
    df = spark.createDataFrame([("a", "s", i, x) for i, x in enumerate(xs)], "series_id string, slice string, ts int, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [r["y"] for r in ewm(df, {"y": ("x", 0.3, 4)}).orderBy("ts").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = pd.Series(xs, dtype=float).ewm(alpha=0.3, adjust=False, min_periods=4).mean()
    assert all((g is None or math.isnan(g)) if math.isnan(w) else g == pytest.approx(w) for g, w in zip(got, want, strict=True))


def test_indicators_equal_pandas(candles):
    rows = walk(150)
    close = pd.Series([r[3] for r in rows])
    got = indicators.add_core_features(candles(rows)).orderBy("ts").toPandas()
    assert got["ema_20"].tolist()[25:] == pytest.approx(close.ewm(span=20, adjust=False, min_periods=20).mean().tolist()[25:])
    assert got["bb_middle"].tolist()[25:] == pytest.approx(close.rolling(20).mean().tolist()[25:])
    rank = got["atr_14"].rolling(100).apply(lambda v: (v <= v[-1]).mean(), raw=True)
    assert got["atr_percentile_100"].tolist()[-20:] == pytest.approx(rank.tolist()[-20:])


@pytest.mark.parametrize("features", [context.add_research_context, context.add_ml_features])
def test_the_future_does_not_change_the_past(candles, features):
    rows = walk(260)
    changed = rows[:230] + [(9, 10, 8, 9.5)] * 30
    past = lambda x: features(candles(x)).filter("bar_idx < 230").drop("payout")
    a, b = (past(x).orderBy("ts").toPandas() for x in (rows, changed))
    pd.testing.assert_frame_equal(a, b)


def test_higher_time_frame_uses_the_completed_bucket(candles):
    rows = [(1 + i / 1000, 1 + i / 1000, 1 + i / 1000, 1 + i / 1000) for i in range(30)]
    got = {r["bar_idx"]: r["htf_5_close"] for r in context.completed_htf(candles(rows), 5).collect()}
    assert got[7] == pytest.approx(rows[4][3]) and got[3] is None
    gap = [(*r, i if i < 10 else i + 10) for i, r in enumerate(rows[:20])]
    got = {r["bar_idx"]: r["htf_5_close"] for r in context.completed_htf(candles(gap), 5).collect()}
    assert got[10] is None and got[15] == pytest.approx(rows[14][3])


def test_regimes(spark):
    base = {"open": 1.0, "high": 2.0, "low": 0.5, "close": 1.0, "ema_20": 1.0, "ema_50": 1.0, "ema_50_slope": 0.0, "adx_14": 10.0, "atr_percentile_100": 0.5, "candle_body_ratio": 0.1}
    rows = [dict(base) for _ in range(25)]
    rows[22] |= {"ema_20": 2.0, "ema_50_slope": 1.0, "adx_14": 30.0}
    rows[24] |= {"close": 3.0, "high": 3.5, "candle_body_ratio": 0.9, "atr_percentile_100": 0.7}
    rows[5] |= {"adx_14": None}
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], "ts int, " + ", ".join(f"{k} double" for k in base)).withColumns({"series_id": F.lit("a"), "slice": F.lit("s")})
    got = {r["ts"]: r["market_regime"] for r in context.add_regime(df).collect()}
    assert (got[22], got[23], got[24], got[5]) == ("strong_uptrend", "quiet_range", "breakout_candidate", "insufficient_data")


def test_grids_and_probability_signal(spark):
    assert {f.name: f.size for f in signals.FAMILIES.values()} == {
        "trend_pullback": 288, "range_reversion": 288, "breakout": 192, "htf_aligned_pullback": 72, "compression_breakout": 32, "sweep_reversal": 48}
    df = spark.createDataFrame([(p,) for p in (0.20, 0.39, 0.40, 0.50, 0.60, 0.61, 0.80, None)], "p double")
    assert [r[0] for r in df.select(signals.probability_signal("p", 0.60)).collect()] == [-1, -1, -1, 0, 1, 1, 1, 0]
    with pytest.raises(ValueError):
        signals.family("none")


def test_every_family_signals_within_its_slice(candles):
    df = candles(walk(320)).withColumn("slice", F.when(F.col("bar_idx") < 300, "a").otherwise("b"))
    for f in signals.FAMILIES.values():
        first = {k: v[0] for k, v in f.grid.items()}
        out = f.prepared(df).withColumn("signal", f.rule(first))
        assert {r[0] for r in out.select("signal").distinct().collect()} <= {-1, 0, 1}
        assert out.filter("slice = 'b' AND signal <> 0").count() == 0  # twenty bars are no warm-up
    assert KEYS == ["series_id", "slice"]
