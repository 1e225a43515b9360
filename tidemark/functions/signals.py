"""Signal rules: columns in {-1, 0, 1} over bars with features.

A rule takes its parameters as a mapping of names to values or columns, so one expression
serves a single parameter set and a join with a table of sets alike. Where both sides hold,
the bearish one decides.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.context import add_research_context
from tidemark.functions.indicators import add_core_features, add_ema, add_rsi, lagged, prior_high, prior_low

LOOKBACKS = (10, 20, 30, 50)
c = F.col


def signal(bull: Column, bear: Column) -> Column:
    return F.when(bear, -1).when(bull, 1).otherwise(0).cast("tinyint")


def _p(params: Mapping, name: str) -> Column:
    value = params[name]
    return value if isinstance(value, Column) else F.lit(value)


def _pick(params: Mapping, name: str, columns: Mapping) -> Column:
    """The column that belongs to a parameter's value."""
    value = params[name]
    if not isinstance(value, Column):
        return c(columns[value])
    out = F
    for k, column in columns.items():
        out = out.when(value == k, c(column))
    return out


def _prior(side: str) -> dict[int, str]:
    return {n: f"{side}_{n}" for n in LOOKBACKS}


def with_lags(features: DataFrame) -> DataFrame:
    """Earlier values and prior ranges that the rules compare with."""
    names = [n for n in ("rsi_14", "macd_hist", "atr_14", "bb_width_percentile_200") if n in features.columns]
    rows = features.withColumns({f"prev_{n}": lagged(n) for n in names})
    return rows.withColumns({f"prior_high_{n}": prior_high(n) for n in LOOKBACKS} | {f"prior_low_{n}": prior_low(n) for n in LOOKBACKS})


def always_call(_=None) -> Column:
    return F.lit(1).cast("tinyint")


def always_put(_=None) -> Column:
    return F.lit(-1).cast("tinyint")


def random_baseline(seed: int = 7) -> Column:
    """A fair coin by hash of series and bar; the same on every run and partitioning."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "series_id", c("bar_idx").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.when(h % 2 == 0, 1).otherwise(-1).cast("tinyint")


def add_ema_crossover(bars: DataFrame, fast: int = 10, slow: int = 30, name: str = "signal") -> DataFrame:
    rows = add_ema(bars, _fast=fast, _slow=slow).withColumns({"_pf": lagged("_fast"), "_ps": lagged("_slow")})
    bull, bear = (c("_fast") > c("_slow")) & (c("_pf") <= c("_ps")), (c("_fast") < c("_slow")) & (c("_pf") >= c("_ps"))
    return rows.withColumn(name, signal(bull, bear)).drop("_fast", "_slow", "_pf", "_ps")


def add_rsi_reversal(bars: DataFrame, period: int = 14, lower: float = 30, upper: float = 70, name: str = "signal") -> DataFrame:
    rows = add_rsi(bars, "_rsi", period).withColumn("_prev", lagged("_rsi"))
    bull, bear = (c("_rsi") > lower) & (c("_prev") <= lower), (c("_rsi") < upper) & (c("_prev") >= upper)
    return rows.withColumn(name, signal(bull, bear)).drop("_rsi", "_prev")


def _recovery(params: Mapping) -> tuple[Column, Column]:
    """Momentum turns with the trend: RSI crosses its trigger again and the MACD histogram moves the same way."""
    up, down = _p(params, "rsi_trigger"), 100.0 - _p(params, "rsi_trigger")
    bull = (c("ema_20") > c("ema_50")) & (c("ema_50_slope") > 0) & (c("rsi_14") > up) & (c("prev_rsi_14") <= up) & (c("macd_hist") > c("prev_macd_hist"))
    bear = (c("ema_20") < c("ema_50")) & (c("ema_50_slope") < 0) & (c("rsi_14") < down) & (c("prev_rsi_14") >= down) & (c("macd_hist") < c("prev_macd_hist"))
    return bull, bear


def trend_pullback(params: Mapping) -> Column:
    near = (
        (c("adx_14") >= _p(params, "adx_min")) & c("atr_percentile_100").between(_p(params, "atr_pct_min"), _p(params, "atr_pct_max"))
        & (F.abs("distance_ema20_atr") <= _p(params, "ema_distance_atr"))
    )
    bull, bear = _recovery(params)
    return signal(near & bull, near & bear)


def range_reversion(params: Mapping) -> Column:
    calm = (c("adx_14") <= _p(params, "adx_max")) & (c("atr_percentile_100") <= _p(params, "atr_pct_max")) & (c("atr_14") > 0)
    room = _p(params, "band_buffer_atr") * c("atr_14")
    bull = calm & (c("close") <= c("bb_lower") + room) & (c("rsi_14") <= _p(params, "rsi_lower"))
    bear = calm & (c("close") >= c("bb_upper") - room) & (c("rsi_14") >= _p(params, "rsi_upper"))
    return signal(bull, bear)


def breakout(params: Mapping) -> Column:
    strong = (c("adx_14") >= _p(params, "adx_min")) & (c("atr_percentile_100") >= _p(params, "atr_pct_min")) & (c("candle_body_ratio") >= _p(params, "body_min"))
    free = ~_p(params, "trend_filter")
    bull = strong & (c("close") > _pick(params, "lookback", _prior("prior_high"))) & (c("macd_hist") > 0) & (free | (c("ema_20") > c("ema_50")))
    bear = strong & (c("close") < _pick(params, "lookback", _prior("prior_low"))) & (c("macd_hist") < 0) & (free | (c("ema_20") < c("ema_50")))
    return signal(bull, bear)


def _htf(params: Mapping, name: str) -> Column:
    return _pick(params, "htf_minutes", {m: f"htf_{m}_{name}" for m in (5, 15)})


def htf_aligned_pullback(params: Mapping) -> Column:
    near = (
        (c("adx_14") >= _p(params, "adx_min")) & (c("atr_percentile_100") <= _p(params, "atr_pct_max"))
        & (F.abs("distance_ema20_atr") <= _p(params, "ema_distance_atr"))
    )
    bull, bear = _recovery(params)
    up = (_htf(params, "trend") == 1) & (_htf(params, "close") > _htf(params, "ema_slow"))
    down = (_htf(params, "trend") == -1) & (_htf(params, "close") < _htf(params, "ema_slow"))
    return signal(near & up & bull, near & down & bear)


def compression_breakout(params: Mapping) -> Column:
    ready = (
        (c("prev_bb_width_percentile_200") <= _p(params, "compression_max")) & (c("candle_body_ratio") >= _p(params, "body_min"))
        & (c("atr_ratio_5_50") >= _p(params, "atr_expansion_min"))
    )
    bull = ready & (_htf(params, "trend") == 1) & (c("close") > _pick(params, "lookback", _prior("prior_high")))
    bear = ready & (_htf(params, "trend") == -1) & (c("close") < _pick(params, "lookback", _prior("prior_low")))
    return signal(bull, bear)


def sweep_reversal(params: Mapping) -> Column:
    high, low = _pick(params, "lookback", _prior("prior_high")), _pick(params, "lookback", _prior("prior_low"))
    over, edge = _p(params, "overshoot_atr") * c("prev_atr_14"), _p(params, "rsi_edge")
    open_ = (c("prev_atr_14") > 0) & (~_p(params, "liquid_core_only") | c("utc_liquid_core"))
    wick = _p(params, "wick_min")
    bull = open_ & (c("low") < low - over) & (c("close") > low) & (c("close") > c("open")) & (c("lower_wick_ratio") >= wick) & (c("rsi_14") <= 100.0 - edge)
    bear = open_ & (c("high") > high + over) & (c("close") < high) & (c("close") < c("open")) & (c("upper_wick_ratio") >= wick) & (c("rsi_14") >= edge)
    return signal(bull, bear)


#: The two frozen rules of the third round.
FROZEN_RANGE = {"adx_max": 30.0, "rsi_lower": 25.0, "rsi_upper": 65.0, "band_buffer_atr": 0.10, "atr_pct_max": 0.70}
FROZEN_SWEEP = {"lookback": 20, "wick_min": 0.65, "rsi_edge": 65.0, "overshoot_atr": 0.0, "liquid_core_only": False}
MODERATE_VOLATILITY = (0.25, 0.50)


def call_only_range_reversion(params: Mapping = FROZEN_RANGE) -> Column:
    return F.when(range_reversion(params) == 1, 1).otherwise(0).cast("tinyint")


def moderate_vol_sweep_reversal(params: Mapping = FROZEN_SWEEP) -> Column:
    low, high = MODERATE_VOLATILITY
    pct = c("atr_percentile_100")
    return F.when((pct > low) & (pct <= high), sweep_reversal(params)).otherwise(0).cast("tinyint")


def probability_signal(p: str, threshold) -> Column:
    """1 from the threshold up, -1 from its mirror down; null gives 0."""
    if not isinstance(threshold, Column):
        if not 0.5 < threshold < 1:
            raise ValueError("threshold must be in (0.5, 1)")
        threshold = F.lit(float(threshold))
    return F.when(c(p) >= threshold, 1).when(c(p) <= 1 - threshold, -1).otherwise(0).cast("tinyint")


@dataclass(frozen=True)
class Family:
    name: str
    rule: Callable[[Mapping], Column]
    features: Callable[[DataFrame], DataFrame]
    grid: Mapping[str, tuple] = field(hash=False)

    @property
    def size(self) -> int:
        return prod(len(v) for v in self.grid.values())

    def prepared(self, bars: DataFrame) -> DataFrame:
        return with_lags(self.features(bars))


#: The parameter grids of the six families.
FAMILIES = {f.name: f for f in (
    Family("trend_pullback", trend_pullback, add_core_features, {
        "adx_min": (15.0, 20.0, 25.0, 30.0), "atr_pct_min": (0.05, 0.15, 0.25), "atr_pct_max": (0.75, 0.90),
        "ema_distance_atr": (0.20, 0.35, 0.50, 0.75), "rsi_trigger": (50.0, 52.5, 55.0)}),
    Family("range_reversion", range_reversion, add_core_features, {
        "adx_max": (15.0, 20.0, 25.0, 30.0), "rsi_lower": (25.0, 30.0, 35.0), "rsi_upper": (65.0, 70.0, 75.0),
        "band_buffer_atr": (0.0, 0.10, 0.20, 0.35), "atr_pct_max": (0.50, 0.70)}),
    Family("breakout", breakout, add_core_features, {
        "lookback": (10, 20, 30, 50), "adx_min": (15.0, 20.0, 25.0, 30.0), "body_min": (0.40, 0.55, 0.70),
        "atr_pct_min": (0.30, 0.50), "trend_filter": (False, True)}),
    Family("htf_aligned_pullback", htf_aligned_pullback, add_research_context, {
        "htf_minutes": (5, 15), "adx_min": (15.0, 20.0, 25.0), "ema_distance_atr": (0.25, 0.50, 0.75),
        "rsi_trigger": (50.0, 55.0), "atr_pct_max": (0.75, 0.90)}),
    Family("compression_breakout", compression_breakout, add_research_context, {
        "htf_minutes": (5, 15), "lookback": (20, 30), "compression_max": (0.20, 0.35), "body_min": (0.50, 0.65),
        "atr_expansion_min": (1.0, 1.2)}),
    Family("sweep_reversal", sweep_reversal, add_research_context, {
        "lookback": (20, 30, 50), "wick_min": (0.50, 0.65), "rsi_edge": (60.0, 65.0), "overshoot_atr": (0.0, 0.10),
        "liquid_core_only": (False, True)}),
)}


def family(name: str) -> Family:
    if name not in FAMILIES:
        raise ValueError(f"unknown strategy family {name!r}; choose from {', '.join(sorted(FAMILIES))}")
    return FAMILIES[name]


#: Named rules for command lines: bars -> bars with `signal`.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "always_call": lambda b: b.withColumn("signal", always_call()),
    "always_put": lambda b: b.withColumn("signal", always_put()),
    "random": lambda b: b.withColumn("signal", random_baseline()),
    "ema_crossover": add_ema_crossover,
    "rsi_reversal": add_rsi_reversal,
    "trend_pullback_v1": lambda b: with_lags(add_core_features(b)).withColumn("signal", trend_pullback(
        {"adx_min": 20.0, "atr_pct_min": 0.15, "atr_pct_max": 0.90, "ema_distance_atr": 0.45, "rsi_trigger": 50.0})),
}
