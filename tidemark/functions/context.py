"""Context features: clock, completed higher time frame, volatility structure, regimes, model inputs."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.indicators import add_core_features, change, full, lagged, percentile_rank, prior_high, prior_low, ratio, span
from tidemark.operators.bars import series, bucket, prior
from tidemark.operators.stream import ewm
from tidemark.schemas import KEYS

HTF_COLUMNS = ["open", "high", "low", "close", "coverage", "ema_fast", "ema_slow", "ema_slow_slope", "return_1", "trend"]

#: The clock windows, by first and last hour.
CLOCK = [(0, 6, "00_06"), (7, 11, "07_11"), (12, 16, "12_16"), (17, 20, "17_20"), (21, 23, "21_23")]


def add_utc_context(bars: DataFrame) -> DataFrame:
    hour = F.hour("ts")
    label = None
    for first, last, name in CLOCK:
        label = (F if label is None else label).when(hour.between(first, last), name)
    return bars.withColumns({
        "utc_hour": hour.cast("tinyint"), "utc_weekday": F.weekday("ts").cast("tinyint"), "utc_liquid_core": hour.between(7, 16), "utc_window": label,
    })


def completed_htf(bars: DataFrame, minutes: int = 15, fast: int = 4, slow: int = 12, min_coverage: float = 0.8) -> DataFrame:
    """Add htf_<minutes>_* columns: each bar gets features of the bucket before its own, never of its own.

    Buckets lie on a dense spine from a series' first to its last, so a mean decays over empty
    buckets and the bar after a gap sees nulls; buckets with too few bars are nulls too.
    """
    if minutes < 2 or not 1 <= fast < slow or not 0 < min_coverage <= 1:
        raise ValueError("need minutes >= 2, 1 <= fast < slow, 0 < min_coverage <= 1")
    width = f"{minutes} minutes"
    rows = bars.withColumn("bucket", bucket("ts", width))
    at = lambda c: F.struct("ts", c)
    there = lambda c: F.when(F.col(c).isNotNull(), at(c))
    htf = rows.groupBy(*KEYS, "bucket").agg(
        F.min(there("open"))["open"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max(there("close"))["close"].alias("close"), F.count("close").alias("base_rows"),
    )
    ends = htf.groupBy(*KEYS).agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    spine = ends.select(*KEYS, F.explode(F.sequence("lo", "hi", F.expr(f"INTERVAL {minutes} MINUTES"))).alias("ts"))
    htf = spine.join(htf.withColumnRenamed("bucket", "ts"), [*KEYS, "ts"], "left").fillna({"base_rows": 0})
    htf = ewm(htf, {"ema_fast": ("close", span(fast), fast), "ema_slow": ("close", span(slow), slow)})
    htf = htf.withColumns({"coverage": F.col("base_rows") / F.lit(float(minutes)), "ema_slow_slope": F.col("ema_slow") - lagged("ema_slow"), "return_1": change("close")})
    up = (F.col("ema_fast") > F.col("ema_slow")) & (F.col("ema_slow_slope") > 0)
    down = (F.col("ema_fast") < F.col("ema_slow")) & (F.col("ema_slow_slope") < 0)
    htf = htf.withColumn("trend", F.when(up, 1.0).when(down, -1.0).otherwise(0.0))
    valid = F.col("base_rows") >= max(1, math.ceil(minutes * min_coverage))
    prefix = f"htf_{minutes}_"
    done = htf.select(*KEYS, F.col("ts").alias("bucket"), *[F.lag(F.when(valid, F.col(c))).over(series()).alias(prefix + c) for c in HTF_COLUMNS])
    return rows.join(done, [*KEYS, "bucket"], "left").drop("bucket")


def add_volatility_context(bars: DataFrame) -> DataFrame:
    rows = add_core_features(bars).withColumn("bb_width_fraction", ratio(F.col("bb_upper") - F.col("bb_lower"), F.col("close")))
    rows = rows.withColumns({
        "atr_ratio_5_50": ratio(F.col("atr_5"), F.col("atr_50")), "bb_width_percentile_200": percentile_rank("bb_width_fraction", 200),
        "prior_high_20": prior_high(20), "prior_low_20": prior_low(20),
    })
    return rows.withColumn("range_position_20", ratio(F.col("close") - F.col("prior_low_20"), F.col("prior_high_20") - F.col("prior_low_20")))


def add_research_context(bars: DataFrame, htf_minutes=(5, 15)) -> DataFrame:
    rows = add_utc_context(add_volatility_context(bars))
    for m in htf_minutes:
        rows = completed_htf(rows, m)
    return rows


@dataclass(frozen=True)
class RegimeThresholds:
    strong_adx: float = 25.0
    weak_adx: float = 18.0
    range_adx_max: float = 18.0
    range_atr_pct_max: float = 0.65
    high_volatility_atr_pct: float = 0.90
    breakout_atr_pct_min: float = 0.60
    breakout_body_min: float = 0.50
    breakout_lookback: int = 20

    def __post_init__(self):
        shares = (self.range_atr_pct_max, self.high_volatility_atr_pct, self.breakout_atr_pct_min, self.breakout_body_min)
        if self.strong_adx < self.weak_adx or self.breakout_lookback < 2 or not all(0 <= s <= 1 for s in shares):
            raise ValueError(f"inconsistent regime thresholds: {self}")


def add_regime(features: DataFrame, t: RegimeThresholds = RegimeThresholds(), column: str = "market_regime") -> DataFrame:
    """Label each bar by the first rule that holds."""
    c = F.col
    needed = ["close", "ema_20", "ema_50", "ema_50_slope", "adx_14", "atr_percentile_100", "candle_body_ratio"]
    lacking = F.lit(False)
    for name in needed:
        lacking = lacking | c(name).isNull()
    rows = features.withColumns({"_hi": full(F.max("high"), "high", t.breakout_lookback, prior(t.breakout_lookback)),
                                 "_lo": full(F.min("low"), "low", t.breakout_lookback, prior(t.breakout_lookback))})
    out = (c("close") > c("_hi")) | (c("close") < c("_lo"))
    bull, bear = (c("ema_20") > c("ema_50")) & (c("ema_50_slope") > 0), (c("ema_20") < c("ema_50")) & (c("ema_50_slope") < 0)
    pct, strong, weak = c("atr_percentile_100"), c("adx_14") >= t.strong_adx, c("adx_14") >= t.weak_adx
    label = (
        F.when(lacking, "insufficient_data")
        .when((pct >= t.breakout_atr_pct_min) & (c("candle_body_ratio") >= t.breakout_body_min) & out, "breakout_candidate")
        .when(bull & strong, "strong_uptrend").when(bear & strong, "strong_downtrend")
        .when((c("adx_14") <= t.range_adx_max) & (pct <= t.range_atr_pct_max), "quiet_range")
        .when(pct >= t.high_volatility_atr_pct, "high_volatility")
        .when(bull & weak, "weak_uptrend").when(bear & weak, "weak_downtrend").otherwise("uncertain")
    )
    return rows.withColumn(column, label).drop("_hi", "_lo")


#: The model inputs of the published protocol, in its order.
ML_FEATURES = [
    "return_1", "return_3", "return_5", "body_atr", "range_atr", "upper_wick_ratio", "lower_wick_ratio", "ema_spread_atr", "ema20_slope_atr",
    "ema50_slope_atr", "distance_ema20_atr", "rsi_14", "macd_hist_atr", "adx_14", "atr_percentile_100", "bb_position", "atr_ratio_5_50",
    "bb_width_percentile_200", "range_position_20", "htf_5_trend", "htf_15_trend", "htf_5_return_1", "htf_15_return_1", "utc_hour_sin",
    "utc_hour_cos", "utc_weekday_sin", "utc_weekday_cos",
]


def add_ml_features(bars: DataFrame) -> DataFrame:
    """The bars with the model inputs added under ML_FEATURES, infinities as null."""
    c = F.col
    rows = add_research_context(bars)
    atr = F.nullif(c("atr_14"), F.lit(0.0))
    turn = lambda f, col, n: f(F.lit(2 * math.pi) * c(col).cast("double") / n)
    made = {
        "return_1": change("close", 1), "return_3": change("close", 3), "return_5": change("close", 5),
        "body_atr": (c("close") - c("open")) / atr, "range_atr": (c("high") - c("low")) / atr,
        "ema_spread_atr": (c("ema_20") - c("ema_50")) / atr, "ema20_slope_atr": c("ema_20_slope") / atr, "ema50_slope_atr": c("ema_50_slope") / atr,
        "macd_hist_atr": c("macd_hist") / atr, "bb_position": ratio(c("close") - c("bb_middle"), c("bb_upper") - c("bb_lower")),
        "utc_hour_sin": turn(F.sin, "utc_hour", 24.0), "utc_hour_cos": turn(F.cos, "utc_hour", 24.0),
        "utc_weekday_sin": turn(F.sin, "utc_weekday", 7.0), "utc_weekday_cos": turn(F.cos, "utc_weekday", 7.0),
    }
    rows = rows.withColumns(made)
    finite = lambda n: F.when(F.abs(c(n)) < float("inf"), c(n)).alias(n)
    return rows.select(*[c(n) for n in rows.columns if n not in ML_FEATURES], *[finite(n) for n in ML_FEATURES])
