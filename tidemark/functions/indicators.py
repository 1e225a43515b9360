"""Trailing indicators as columns: each row sees itself and earlier rows of its slice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bars import series, back, prior
from tidemark.operators.stream import ewm


def full(agg: Column, col: str, n: int, frame=None) -> Column:
    """An aggregate over n rows, null unless all n are there and not null."""
    frame = frame or back(n)
    return F.when(F.count(col).over(frame) == n, agg.over(frame))


def sma(col: str, n: int) -> Column:
    return full(F.avg(col), col, n)


def prior_high(n: int) -> Column:
    return full(F.max("high"), "high", n, prior(n))


def prior_low(n: int) -> Column:
    return full(F.min("low"), "low", n, prior(n))


def lagged(col: str, n: int = 1) -> Column:
    return F.lag(col, n).over(series())


def change(col: str, n: int = 1) -> Column:
    return F.try_divide(F.col(col), lagged(col, n)) - 1


def true_range() -> Column:
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - lagged("close")), F.abs(F.col("low") - lagged("close")))


def percentile_rank(col: str, n: int) -> Column:
    """Share of the last n values that are at most the current one."""
    values = F.collect_list(col).over(back(n))
    return F.when(F.count(col).over(back(n)) == n, F.size(F.filter(values, lambda v: v <= F.col(col))) / F.lit(float(n)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def span(n: int) -> float:
    return 2.0 / (n + 1)


def rsi_of(gain: str, loss: str) -> Column:
    g, s = F.col(gain), F.col(loss)
    return F.when((s == 0) & (g > 0), 100.0).when((g == 0) & (s > 0), 0.0).otherwise(100.0 - 100.0 / (1.0 + ratio(g, s)))


def add_ema(df: DataFrame, **spans: int) -> DataFrame:
    """name=span: exponential means of close."""
    return ewm(df, {name: ("close", span(n), n) for name, n in spans.items()})


def add_rsi(df: DataFrame, name: str = "rsi_14", n: int = 14) -> DataFrame:
    step = F.col("close") - lagged("close")
    rows = df.withColumns({"_g": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "_l": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))})
    rows = ewm(rows, {"_ag": ("_g", 1 / n, n), "_al": ("_l", 1 / n, n)})
    return rows.withColumn(name, rsi_of("_ag", "_al")).drop("_g", "_l", "_ag", "_al")


def _recursive(df: DataFrame) -> DataFrame:
    """All exponential means of the feature set, in two passes: those of prices, and those of the first pass."""
    step = F.col("close") - lagged("close")
    up, down = F.col("high") - lagged("high"), lagged("low") - F.col("low")
    rows = df.withColumns({
        "_tr": true_range(), "_g": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "_l": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0))),
        "_up": F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)), "_dn": F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)),
    })
    specs = {f"_e{n}": ("close", span(n), n) for n in (12, 26)} | {f"ema_{n}": ("close", span(n), n) for n in (20, 50)}
    specs |= {f"atr_{n}": ("_tr", 1 / n, n) for n in (5, 14, 50)}
    specs |= {"_ag": ("_g", 1 / 14, 14), "_al": ("_l", 1 / 14, 14), "_eu": ("_up", 1 / 14, 14), "_ed": ("_dn", 1 / 14, 14)}
    rows = ewm(rows, specs)
    plus, minus = 100 * ratio(F.col("_eu"), F.col("atr_14")), 100 * ratio(F.col("_ed"), F.col("atr_14"))
    rows = rows.withColumns({"macd": F.col("_e12") - F.col("_e26"), "_dx": 100 * ratio(F.abs(plus - minus), plus + minus), "rsi_14": rsi_of("_ag", "_al")})
    rows = ewm(rows, {"macd_signal": ("macd", span(9), 9), "adx_14": ("_dx", 1 / 14, 14)})
    return rows.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop(*[c for c in rows.columns if c.startswith("_")])


def add_core_features(bars: DataFrame) -> DataFrame:
    """The core indicator set, and atr_5 and atr_50, which the same pass yields."""
    rows = _recursive(bars)
    candle = F.col("high") - F.col("low")
    rows = rows.withColumns({
        "ema_20_slope": F.col("ema_20") - lagged("ema_20"), "ema_50_slope": F.col("ema_50") - lagged("ema_50"),
        "bb_middle": sma("close", 20), "_sd": full(F.stddev_pop("close"), "close", 20),
        "recent_high_20": full(F.max("high"), "high", 20), "recent_low_20": full(F.min("low"), "low", 20),
        "atr_percentile_100": percentile_rank("atr_14", 100),
    })
    return rows.withColumns({
        "bb_lower": F.col("bb_middle") - 2 * F.col("_sd"), "bb_upper": F.col("bb_middle") + 2 * F.col("_sd"),
        "distance_ema20_atr": ratio(F.col("close") - F.col("ema_20"), F.col("atr_14")),
        "candle_body_ratio": ratio(F.abs(F.col("close") - F.col("open")), candle),
        "upper_wick_ratio": ratio(F.col("high") - F.greatest("open", "close"), candle),
        "lower_wick_ratio": ratio(F.least("open", "close") - F.col("low"), candle),
    }).drop("_sd")
