"""Named queries over the driver's tables, and the same results in SQL.

Ticks are `events` with a spread of two cents around `value`; payout observations are its
`purchase` rows; daily series come from `orders` and `lineitem`. Measures are rounded to six
places on both sides, as the engines add floating-point numbers in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import context, indicators, signals
from tidemark.operators import consolidate, joins, metrics, resample, validate
from tidemark.operators.bars import contiguous_ahead, inferred_interval, numbered, ticks_to_candles, with_breaks
from tidemark.operators.settle import Settlement, direction_target, settle
from tidemark.schemas import PRICES

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL where SQL can say it."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long, flags as int: the forms that the SQL gives."""
    cast = {"int": "bigint", "tinyint": "bigint", "smallint": "bigint", "boolean": "int"}
    return df.select(*[
        (F.round(c, places) + 0.0 if t == "double" else F.col(c).cast(cast[t]) if t in cast else F.col(c)).alias(c) for c, t in df.dtypes
    ])


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select("ts", (F.col("value") + 0.01).alias("ask"), (F.col("value") - 0.01).alias("bid"), F.lit(1.0).alias("ask_volume"), F.lit(1.0).alias("bid_volume"),
                    F.lit("ALL").alias("series_id"), "event_type")


def bars(spark: SparkSession, sf: str, minutes: int = 60, by_type: bool = False) -> DataFrame:
    t = ticks(spark, sf)
    return numbered(ticks_to_candles(t.withColumn("series_id", F.col("event_type")) if by_type else t, f"{minutes} minutes"))


def bars_sql(minutes: int = 60, by: str = "'ALL'") -> str:
    return f"""t AS (
  SELECT ts, {by} AS series_id, ((value + 0.01::DOUBLE) + (value - 0.01::DOUBLE)) / 2 AS px, (value + 0.01::DOUBLE) - (value - 0.01::DOUBLE) AS spread FROM events
), b AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS bar_idx FROM (
    SELECT series_id, time_bucket(INTERVAL '{minutes} minutes', ts) AS ts, arg_min(px, ts) AS open, max(px) AS high, min(px) AS low, arg_max(px, ts) AS close,
      2.0::DOUBLE * count(*) AS volume, avg(spread) AS spread_mean
    FROM (SELECT * FROM t) GROUP BY ALL)
)"""


def r(*names: str, places: int = 6) -> str:
    return ", ".join(f"round({n}, {places}) + 0.0::DOUBLE AS {n}" for n in names)


def ew_sql(name: str, source: str, specs: dict[str, tuple[str, float, int]], key: str = "bar_idx") -> str:
    """Recursive CTEs that step along `key` of a source of one series: columns of specs, by key."""
    cols = list(enumerate(specs.items()))
    start = ", ".join(f"{x}::DOUBLE AS y{i}, 1.0::DOUBLE AS w{i}, ({x} IS NOT NULL)::INT AS c{i}" for i, (_, (x, _, _)) in cols)
    step = ", ".join(
        f"CASE WHEN s.{x} IS NULL THEN e.y{i} WHEN e.y{i} IS NULL THEN s.{x} ELSE (e.w{i} * {1 - a!r} * e.y{i} + {a!r} * s.{x}) / (e.w{i} * {1 - a!r} + {a!r}) END, "
        f"CASE WHEN s.{x} IS NOT NULL OR e.y{i} IS NULL THEN 1.0::DOUBLE ELSE e.w{i} * {1 - a!r} END, e.c{i} + (s.{x} IS NOT NULL)::INT" for i, (_, (x, a, _)) in cols)
    out = ", ".join(f"CASE WHEN c{i} >= {m} THEN y{i} END AS {n}" for i, (n, (_, _, m)) in cols)
    return f"""{name}_r AS (
  SELECT {key} AS i, {start} FROM {source} WHERE {key} = 0
  UNION ALL SELECT s.{key}, {step} FROM {name}_r e JOIN {source} s ON s.{key} = e.i + 1
), {name} AS MATERIALIZED (SELECT i AS {key}, {out} FROM {name}_r)"""


def full_sql(agg: str, col: str, n: int, frame: str | None = None) -> str:
    frame = frame or f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    w = f"OVER (ORDER BY ts {frame})"
    return f"CASE WHEN count({col}) {w} = {n} THEN {agg} {w} END"


def prior_sql(agg: str, col: str, n: int) -> str:
    return full_sql(f"{agg}({col})", col, n, f"ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING")


def rank_sql(col: str, n: int) -> str:
    w = f"OVER (ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} = {n} THEN len(list_filter(list({col}) {w}, lambda v: v <= {col})) / {n}.0::DOUBLE END"


def lag(col: str, n: int = 1) -> str:
    return f"lag({col}, {n}) OVER (ORDER BY ts)"


LOOK = ", ".join(f"{prior_sql('max', 'high', n)} AS ph{n}, {prior_sql('min', 'low', n)} AS pl{n}" for n in signals.LOOKBACKS)
E1 = {f"e{n}": ("close", 2 / (n + 1), n) for n in (12, 26)} | {f"ema_{n}": ("close", 2 / (n + 1), n) for n in (20, 50)}
E1 |= {f"atr_{n}": ("tr", 1 / n, n) for n in (5, 14, 50)} | {k: (v, 1 / 14, 14) for k, v in {"ag": "g", "al": "l", "eu": "up", "ed": "dn"}.items()}


def dense_sql() -> str:
    """CTEs up to `b`: the hourly bars set at one a minute, so that completed higher time frames are whole."""
    return bars_sql().replace("b AS MATERIALIZED", "b0 AS MATERIALIZED") + ", b AS MATERIALIZED (SELECT * REPLACE (TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * bar_idx AS ts) FROM b0)"


def core_sql(minutes: int = 60, source: str | None = None) -> str:
    """CTEs up to `f`: bars (of source, which ends with `b`) with the core features and the volatility context."""
    return f"""{source or bars_sql(minutes)}, d0 AS (
  SELECT *, close - {lag('close')} AS dc, high - {lag('high')} AS u, {lag('low')} - low AS w, {lag('close')} AS pc FROM b
), d AS MATERIALIZED (
  SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, CASE WHEN dc IS NOT NULL THEN greatest(dc, 0.0) END AS g,
    CASE WHEN dc IS NOT NULL THEN greatest(-dc, 0.0) END AS l, CASE WHEN u > w AND u > 0 THEN u ELSE 0.0 END AS up, CASE WHEN w > u AND w > 0 THEN w ELSE 0.0 END AS dn FROM d0
), {ew_sql('p1', 'd', E1)}, m0 AS (
  SELECT d.*, p1.* EXCLUDE (bar_idx), e12 - e26 AS macd, 100 * eu / nullif(atr_14, 0) AS plus, 100 * ed / nullif(atr_14, 0) AS minus,
    CASE WHEN al = 0 AND ag > 0 THEN 100.0 WHEN ag = 0 AND al > 0 THEN 0.0 ELSE 100.0 - 100.0 / (1.0 + ag / nullif(al, 0)) END AS rsi_14
  FROM d JOIN p1 USING (bar_idx)
), m AS MATERIALIZED (SELECT *, 100 * abs(plus - minus) / nullif(plus + minus, 0) AS dx FROM m0
), {ew_sql('p2', 'm', {'macd_signal': ('macd', 0.2, 9), 'adx_14': ('dx', 1 / 14, 14)})}, c0 AS (
  SELECT m.*, p2.macd_signal, p2.adx_14, macd - p2.macd_signal AS macd_hist, ema_20 - {lag('ema_20')} AS ema_20_slope, ema_50 - {lag('ema_50')} AS ema_50_slope,
    {full_sql('avg(close)', 'close', 20)} AS bb_middle, {full_sql('stddev_pop(close)', 'close', 20)} AS sd,
    {full_sql('max(high)', 'high', 20)} AS recent_high_20, {full_sql('min(low)', 'low', 20)} AS recent_low_20, {rank_sql('atr_14', 100)} AS atr_percentile_100
  FROM m JOIN p2 USING (bar_idx)
), c1 AS (
  SELECT *, bb_middle - 2 * sd AS bb_lower, bb_middle + 2 * sd AS bb_upper, (close - ema_20) / nullif(atr_14, 0) AS distance_ema20_atr,
    abs(close - open) / nullif(high - low, 0) AS candle_body_ratio, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick_ratio,
    (least(open, close) - low) / nullif(high - low, 0) AS lower_wick_ratio, atr_5 / nullif(atr_50, 0) AS atr_ratio_5_50,
    {prior_sql('max', 'high', 20)} AS prior_high_20, {prior_sql('min', 'low', 20)} AS prior_low_20 FROM c0
), c2 AS (
  SELECT *, (bb_upper - bb_lower) / nullif(close, 0) AS bb_width_fraction, (close - prior_low_20) / nullif(prior_high_20 - prior_low_20, 0) AS range_position_20 FROM c1
), f AS MATERIALIZED (
  SELECT *, {rank_sql('bb_width_fraction', 200)} AS bb_width_percentile_200, {lag('rsi_14')} AS prev_rsi_14, {lag('macd_hist')} AS prev_macd_hist, {lag('atr_14')} AS prev_atr_14,
    hour(ts) AS utc_hour, isodow(ts) - 1 AS utc_weekday FROM c2
)"""


CORE = ["ema_20", "ema_50", "ema_20_slope", "ema_50_slope", "rsi_14", "macd", "macd_signal", "macd_hist", "atr_14", "adx_14", "bb_lower", "bb_middle", "bb_upper",
        "distance_ema20_atr", "candle_body_ratio", "upper_wick_ratio", "lower_wick_ratio", "recent_high_20", "recent_low_20", "atr_percentile_100"]
VOLATILITY = ["atr_5", "atr_50", "atr_ratio_5_50", "bb_width_fraction", "bb_width_percentile_200", "prior_high_20", "prior_low_20", "range_position_20"]

# --- bars, time base, validation ---------------------------------------------------------------------------------------------------------------------------

for _name, _m in (("candles_1h", 60), ("candles_5m", 5)):
    @query(_name, f"WITH {bars_sql(_m)} SELECT series_id, ts, {r(*PRICES, 'volume', 'spread_mean')} FROM b")
    def _candles(spark, sf, m=_m):
        return rounded(bars(spark, sf, m).select("series_id", "ts", *PRICES, "volume", "spread_mean"))


@query("candles_by_series", f"WITH {bars_sql(60, 'event_type')} SELECT series_id, ts, bar_idx, {r(*PRICES)} FROM b")
def candles_by_series(spark, sf):
    return rounded(bars(spark, sf, 60, True).select("series_id", "ts", "bar_idx", *PRICES))


def _daily_sql(table, ts, px):
    return f"SELECT date_trunc('day', {ts}) AS ts, round(max({px}), 6) AS high, round(min({px}), 6) AS low, count(*) AS n FROM {table} GROUP BY ALL"


for _t, _ts, _px in (("orders", "o_orderdate", "o_totalprice"), ("lineitem", "l_shipdate", "l_extendedprice")):
    @query(f"daily_range_{_t}", _daily_sql(_t, _ts, _px))
    def _daily(spark, sf, t=_t, ts=_ts, px=_px):
        d = spark.read.parquet(f"{sf}/{t}.parquet").select(F.date_trunc("day", ts).cast("timestamp_ntz").alias("ts"), px)
        return d.groupBy("ts").agg(F.round(F.max(px), 6).alias("high"), F.round(F.min(px), 6).alias("low"), F.count(F.lit(1)).alias("n"))


STEPS = """s AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS step, lag(ts) OVER (ORDER BY ts) AS before FROM b
), i AS (SELECT step AS iv FROM s WHERE step > 0 GROUP BY step ORDER BY count(*) DESC, step LIMIT 1
), k AS (SELECT *, sum(CASE WHEN step IS NULL OR step = iv THEN 0 ELSE 1 END) OVER (ORDER BY ts) AS breaks FROM s, i)"""


@query("bar_interval", f"WITH {bars_sql(5)}, {STEPS} SELECT iv AS interval_us FROM i")
def bar_interval(spark, sf):
    return inferred_interval(bars(spark, sf, 5)).select("interval_us")


@query("contiguous_horizons", f"WITH {bars_sql(5)}, {STEPS} SELECT ts, coalesce((lead(breaks, 3) OVER (ORDER BY ts) = breaks)::INT, 0) AS ahead_3 FROM k")
def contiguous_horizons(spark, sf):
    return rounded(with_breaks(bars(spark, sf, 5)).select("ts", contiguous_ahead(3).alias("ahead_3")))


@query("dataset_diagnostics", f"""WITH {bars_sql(5)}, {STEPS}, g AS (
  SELECT *, CASE WHEN step > iv THEN greatest(1, round_even(step::DOUBLE / iv, 0)::BIGINT) - 1 ELSE 0 END AS missing,
    EXISTS (SELECT 1 FROM generate_series(before::DATE, ts::DATE, INTERVAL 1 DAY) d(x) WHERE isodow(x) >= 6) AS we FROM k
) SELECT series_id, count(*) AS row_count, min(ts) AS start_ts, max(ts) AS end_ts, count(*) - count(DISTINCT ts) AS duplicate_timestamps,
  count(*) FILTER (WHERE high < greatest(open, close, low) OR low > least(open, close, high)) AS invalid_ohlc, any_value(iv) AS interval_us, sum(missing)::BIGINT AS missing_intervals,
  count(*) FILTER (WHERE missing > 0) AS gap_events, max(step) FILTER (WHERE missing > 0) AS largest_gap_us,
  coalesce(sum(missing) FILTER (WHERE missing > 0 AND we), 0)::BIGINT AS weekend_missing, count(*) FILTER (WHERE missing > 0 AND we) AS weekend_gap_events
FROM g GROUP BY series_id""")
def dataset_diagnostics(spark, sf):
    return validate.diagnose(bars(spark, sf, 5)).drop("slice")


PARTS = ", ".join(f"sum(('0x' || substr(h, {1 + 12 * k}, 12))::BIGINT)::VARCHAR AS s{k}" for k in range(5))


def fingerprint_sql(source: str, columns: list[str]) -> str:
    """The fingerprint of a source, columns by name."""
    text = ", ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in sorted(columns))
    return f"""h AS (SELECT sha256(concat_ws(',', {text})) AS h FROM {source}), s AS (SELECT count(*) AS row_count, {PARTS} FROM h)
SELECT row_count, sha256(concat_ws('|', '{','.join(sorted(columns))}', row_count::VARCHAR, s0, s1, s2, s3, s4)) AS fingerprint FROM s"""


@query("table_fingerprint", f"WITH {fingerprint_sql('nation', ['n_name', 'n_nationkey', 'n_regionkey'])}")
def table_fingerprint(spark, sf):
    return validate.fingerprint(spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey"))


@query("candle_fingerprint", f"""WITH {bars_sql()}, w AS (SELECT epoch_us(ts) AS ts, {', '.join(f'round({c} * 10000)::BIGINT AS {c}' for c in PRICES)} FROM b),
{fingerprint_sql('w', ['ts', *PRICES])}""")
def candle_fingerprint(spark, sf):
    """Prices as whole ten-thousandths and times as microseconds, whose texts all engines agree on."""
    b = bars(spark, sf).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), *[F.round(F.col(c) * 10000).cast("long").alias(c) for c in PRICES])
    return validate.fingerprint(b)


# --- features ----------------------------------------------------------------------------------------------------------------------------------------------


@query("bounded_indicators", f"""WITH {bars_sql(5)}, x AS (SELECT *, {full_sql('avg(close)', 'close', 20)} AS sma_20, {full_sql('stddev_pop(close)', 'close', 20)} AS sd,
  greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS true_range, {rank_sql('close', 100)} AS close_rank_100,
  {prior_sql('max', 'high', 20)} AS prior_high_20, close / nullif({lag('close', 3)}, 0) - 1 AS return_3 FROM b)
SELECT ts, {r('sma_20', 'true_range', 'close_rank_100', 'prior_high_20', 'return_3')}, round(sma_20 + 2 * sd, 6) + 0.0 AS bb_upper FROM x""")
def bounded_indicators(spark, sf):
    b = bars(spark, sf, 5)
    return rounded(b.select(
        "ts", indicators.sma("close", 20).alias("sma_20"), indicators.true_range().alias("true_range"), indicators.percentile_rank("close", 100).alias("close_rank_100"),
        indicators.prior_high(20).alias("prior_high_20"), indicators.change("close", 3).alias("return_3"),
        (indicators.sma("close", 20) + 2 * indicators.full(F.stddev_pop("close"), "close", 20)).alias("bb_upper")))


@query("core_features", f"WITH RECURSIVE {core_sql()} SELECT ts, {r(*CORE)} FROM f")
def core_features(spark, sf):
    return rounded(indicators.add_core_features(bars(spark, sf)).select("ts", *CORE))


@query("volatility_context", f"WITH RECURSIVE {core_sql()} SELECT ts, {r(*VOLATILITY)} FROM f")
def volatility_context(spark, sf):
    return rounded(context.add_volatility_context(bars(spark, sf)).select("ts", *VOLATILITY))


@query("utc_context", f"""WITH {bars_sql(5)} SELECT ts, hour(ts) AS utc_hour, isodow(ts) - 1 AS utc_weekday, (hour(ts) BETWEEN 7 AND 16)::INT AS utc_liquid_core,
  CASE WHEN hour(ts) <= 6 THEN '00_06' WHEN hour(ts) <= 11 THEN '07_11' WHEN hour(ts) <= 16 THEN '12_16' WHEN hour(ts) <= 20 THEN '17_20' ELSE '21_23' END AS utc_window FROM b""")
def utc_context(spark, sf):
    return rounded(context.add_utc_context(bars(spark, sf, 5)).select("ts", "utc_hour", "utc_weekday", "utc_liquid_core", "utc_window"))


def htf_sql(minutes: int, coverage: float) -> str:
    """CTEs up to `h<minutes>`: per bucket what a bar in it may see, the features of the bucket before."""
    m, need = minutes, max(1, -(-minutes * coverage // 1))
    return f"""ha{m} AS (
  SELECT time_bucket(INTERVAL '{m} minutes', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, count(close) AS n FROM b GROUP BY ALL
), hs{m} AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL '{m} minutes')) AS ts FROM ha{m}
), hb{m} AS MATERIALIZED (SELECT sp.ts, open, high, low, close, coalesce(n, 0) AS n, row_number() OVER (ORDER BY sp.ts) - 1 AS hi FROM hs{m} sp LEFT JOIN ha{m} USING (ts)
), {ew_sql(f'hp{m}', f'hb{m}', {'ema_fast': ('close', 2 / 5, 4), 'ema_slow': ('close', 2 / 13, 12)}, 'hi')}, hc{m} AS (
  SELECT h.*, ema_fast, ema_slow, n / {float(m)}::DOUBLE AS coverage, ema_slow - {lag('ema_slow')} AS ema_slow_slope, close / nullif({lag('close')}, 0) - 1 AS return_1 FROM hb{m} h JOIN hp{m} USING (hi)
), hd{m} AS (
  SELECT *, CASE WHEN ema_fast > ema_slow AND ema_slow_slope > 0 THEN 1.0 WHEN ema_fast < ema_slow AND ema_slow_slope < 0 THEN -1.0 ELSE 0.0 END AS trend, n >= {need} AS ok FROM hc{m}
), h{m} AS (SELECT ts AS bucket, {', '.join(f"lag(CASE WHEN ok THEN {c} END) OVER (ORDER BY ts) AS htf_{m}_{c}" for c in context.HTF_COLUMNS)} FROM hd{m})"""


def research_sql(source: str | None = None) -> str:
    """CTEs up to `fx`: the dense bars with all features, two higher time frames and the ranges that rules compare with."""
    joins_ = " ".join(f"LEFT JOIN h{m} ON h{m}.bucket = time_bucket(INTERVAL '{m} minutes', f.ts)" for m in (5, 15))
    return f"""{core_sql(source=source or dense_sql())}, {htf_sql(5, 0.8)}, {htf_sql(15, 0.8)}, fy AS (
  SELECT f.*, h5.* EXCLUDE (bucket), h15.* EXCLUDE (bucket) FROM f {joins_}
), fx AS MATERIALIZED (SELECT *, {LOOK}, {lag('bb_width_percentile_200')} AS prev_bb_width_percentile_200 FROM fy)"""


HTF60 = [f"htf_60_{c}" for c in context.HTF_COLUMNS]


@query("completed_higher_timeframe", f"""WITH RECURSIVE {bars_sql(5)}, {htf_sql(60, 0.15)}
SELECT b.ts, {r(*HTF60)} FROM b LEFT JOIN h60 ON h60.bucket = time_bucket(INTERVAL '60 minutes', b.ts)""")
def completed_higher_timeframe(spark, sf):
    return rounded(context.completed_htf(bars(spark, sf, 5), 60, min_coverage=0.15).select("ts", *HTF60))


REGIME_SQL = """CASE WHEN close IS NULL OR ema_20 IS NULL OR ema_50 IS NULL OR ema_50_slope IS NULL OR adx_14 IS NULL OR atr_percentile_100 IS NULL OR candle_body_ratio IS NULL THEN 'insufficient_data'
  WHEN atr_percentile_100 >= 0.6 AND candle_body_ratio >= 0.5 AND (close > prior_high_20 OR close < prior_low_20) THEN 'breakout_candidate'
  WHEN ema_20 > ema_50 AND ema_50_slope > 0 AND adx_14 >= 25 THEN 'strong_uptrend' WHEN ema_20 < ema_50 AND ema_50_slope < 0 AND adx_14 >= 25 THEN 'strong_downtrend'
  WHEN adx_14 <= 18 AND atr_percentile_100 <= 0.65 THEN 'quiet_range' WHEN atr_percentile_100 >= 0.9 THEN 'high_volatility'
  WHEN ema_20 > ema_50 AND ema_50_slope > 0 AND adx_14 >= 18 THEN 'weak_uptrend' WHEN ema_20 < ema_50 AND ema_50_slope < 0 AND adx_14 >= 18 THEN 'weak_downtrend' ELSE 'uncertain' END"""


@query("market_regimes", f"WITH RECURSIVE {core_sql()} SELECT ts, {REGIME_SQL} AS market_regime FROM f")
def market_regimes(spark, sf):
    return context.add_regime(indicators.add_core_features(bars(spark, sf))).select("ts", "market_regime")


def dense(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly bars set at one a minute."""
    return bars(spark, sf).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, bar_idx, 0)"))


def inputs_sql() -> str:
    """CTEs up to `x`: the dense bars with all model inputs."""
    return f"""{research_sql()}, x AS (
  SELECT * , {', '.join(f"close / nullif({lag('close', n)}, 0) - 1 AS return_{n}" for n in (1, 3, 5))}, (close - open) / nullif(atr_14, 0) AS body_atr, (high - low) / nullif(atr_14, 0) AS range_atr,
    (ema_20 - ema_50) / nullif(atr_14, 0) AS ema_spread_atr, ema_20_slope / nullif(atr_14, 0) AS ema20_slope_atr, ema_50_slope / nullif(atr_14, 0) AS ema50_slope_atr,
    macd_hist / nullif(atr_14, 0) AS macd_hist_atr, (close - bb_middle) / nullif(bb_upper - bb_lower, 0) AS bb_position,
    sin(2 * pi() * utc_hour / 24.0) AS utc_hour_sin, cos(2 * pi() * utc_hour / 24.0) AS utc_hour_cos, sin(2 * pi() * utc_weekday / 7.0) AS utc_weekday_sin, cos(2 * pi() * utc_weekday / 7.0) AS utc_weekday_cos FROM fx
)"""


@query("model_inputs", f"WITH RECURSIVE {inputs_sql()} SELECT ts, {r(*context.ML_FEATURES)} FROM x")
def model_inputs(spark, sf):
    return rounded(context.add_ml_features(dense(spark, sf)).select("ts", *context.ML_FEATURES))


# --- signals -----------------------------------------------------------------------------------------------------------------------------------------------

LOOSE = {
    "trend_pullback": {"adx_min": 5.0, "atr_pct_min": 0.05, "atr_pct_max": 0.95, "ema_distance_atr": 1.5, "rsi_trigger": 50.0},
    "range_reversion": {"adx_max": 100.0, "rsi_lower": 48.0, "rsi_upper": 52.0, "band_buffer_atr": 1.2, "atr_pct_max": 0.95},
    "breakout": {"lookback": 10, "adx_min": 5.0, "body_min": 0.2, "atr_pct_min": 0.1, "trend_filter": True},
    "htf_aligned_pullback": {"htf_minutes": 5, "adx_min": 5.0, "ema_distance_atr": 2.0, "rsi_trigger": 50.0, "atr_pct_max": 1.0},
    "compression_breakout": {"htf_minutes": 15, "lookback": 10, "compression_max": 0.9, "body_min": 0.1, "atr_expansion_min": 0.7},
    "sweep_reversal": {"lookback": 10, "wick_min": 0.2, "rsi_edge": 50.5, "overshoot_atr": 0.0, "liquid_core_only": False},
}


def rule_sql(family: str, p: dict) -> tuple[str, str]:
    """(bullish, bearish) condition over fx, for parameters that are values or columns."""
    pick = lambda key, stem, of: f"CASE {p[key]} " + " ".join(f"WHEN {v} THEN {stem.format(v)}" for v in of) + " END"
    high, low = (pick("lookback", x + "{}", signals.LOOKBACKS) if "lookback" in p else "" for x in ("ph", "pl"))
    htf = {n: pick("htf_minutes", "htf_{}_" + n, (5, 15)) for n in ("trend", "close", "ema_slow")} if "htf_minutes" in p else {}
    up = f"ema_20 > ema_50 AND ema_50_slope > 0 AND rsi_14 > {p.get('rsi_trigger')} AND prev_rsi_14 <= {p.get('rsi_trigger')} AND macd_hist > prev_macd_hist"
    down = f"ema_20 < ema_50 AND ema_50_slope < 0 AND rsi_14 < 100 - {p.get('rsi_trigger')} AND prev_rsi_14 >= 100 - {p.get('rsi_trigger')} AND macd_hist < prev_macd_hist"
    if family == "trend_pullback":
        near = f"adx_14 >= {p['adx_min']} AND atr_percentile_100 BETWEEN {p['atr_pct_min']} AND {p['atr_pct_max']} AND abs(distance_ema20_atr) <= {p['ema_distance_atr']}"
        return f"{near} AND {up}", f"{near} AND {down}"
    if family == "range_reversion":
        calm = f"adx_14 <= {p['adx_max']} AND atr_percentile_100 <= {p['atr_pct_max']} AND atr_14 > 0"
        return (f"{calm} AND close <= bb_lower + {p['band_buffer_atr']} * atr_14 AND rsi_14 <= {p['rsi_lower']}",
                f"{calm} AND close >= bb_upper - {p['band_buffer_atr']} * atr_14 AND rsi_14 >= {p['rsi_upper']}")
    if family == "breakout":
        strong = f"adx_14 >= {p['adx_min']} AND atr_percentile_100 >= {p['atr_pct_min']} AND candle_body_ratio >= {p['body_min']}"
        return (f"{strong} AND close > {high} AND macd_hist > 0 AND (NOT {p['trend_filter']} OR ema_20 > ema_50)",
                f"{strong} AND close < {low} AND macd_hist < 0 AND (NOT {p['trend_filter']} OR ema_20 < ema_50)")
    if family == "htf_aligned_pullback":
        near = f"adx_14 >= {p['adx_min']} AND atr_percentile_100 <= {p['atr_pct_max']} AND abs(distance_ema20_atr) <= {p['ema_distance_atr']}"
        return f"{near} AND {htf['trend']} = 1 AND {htf['close']} > {htf['ema_slow']} AND {up}", f"{near} AND {htf['trend']} = -1 AND {htf['close']} < {htf['ema_slow']} AND {down}"
    if family == "compression_breakout":
        ready = f"prev_bb_width_percentile_200 <= {p['compression_max']} AND candle_body_ratio >= {p['body_min']} AND atr_ratio_5_50 >= {p['atr_expansion_min']}"
        return f"{ready} AND {htf['trend']} = 1 AND close > {high}", f"{ready} AND {htf['trend']} = -1 AND close < {low}"
    open_ = f"prev_atr_14 > 0 AND (NOT {p['liquid_core_only']} OR utc_hour BETWEEN 7 AND 16)"
    return (f"{open_} AND low < {low} - {p['overshoot_atr']} * prev_atr_14 AND close > {low} AND close > open AND lower_wick_ratio >= {p['wick_min']} AND rsi_14 <= 100 - {p['rsi_edge']}",
            f"{open_} AND high > {high} + {p['overshoot_atr']} * prev_atr_14 AND close < {high} AND close < open AND upper_wick_ratio >= {p['wick_min']} AND rsi_14 >= {p['rsi_edge']}")


def side_sql(bull: str, bear: str) -> str:
    return f"CASE WHEN {bear} THEN -1 WHEN {bull} THEN 1 ELSE 0 END"


for _family, _params in LOOSE.items():
    @query(f"signal_{_family}", f"WITH RECURSIVE {research_sql()} SELECT ts, ({side_sql(*rule_sql(_family, _params))})::BIGINT AS signal FROM fx")
    def _signal(spark, sf, name=_family, params=_params):
        made = signals.with_lags(context.add_research_context(dense(spark, sf)))
        return rounded(made.select("ts", signals.FAMILIES[name].rule(params).alias("signal")))


RANGE, SWEEP = rule_sql("range_reversion", LOOSE["range_reversion"]), rule_sql("sweep_reversal", LOOSE["sweep_reversal"])


@query("signal_frozen_rules", f"""WITH RECURSIVE {research_sql()} SELECT ts, (CASE WHEN ({side_sql(*RANGE)}) = 1 THEN 1 ELSE 0 END)::BIGINT AS call_only_range,
  (CASE WHEN atr_percentile_100 > 0.25 AND atr_percentile_100 <= 0.5 THEN {side_sql(*SWEEP)} ELSE 0 END)::BIGINT AS moderate_sweep,
  (CASE WHEN ({side_sql(*rule_sql('range_reversion', signals.FROZEN_RANGE))}) = 1 THEN 1 ELSE 0 END)::BIGINT AS frozen_range,
  (CASE WHEN atr_percentile_100 > 0.25 AND atr_percentile_100 <= 0.5 THEN {side_sql(*rule_sql('sweep_reversal', signals.FROZEN_SWEEP))} ELSE 0 END)::BIGINT AS frozen_sweep FROM fx""")
def signal_frozen_rules(spark, sf):
    """The two rules of the third round, with loose parameters, so that they fire here, and with their own."""
    made = signals.with_lags(context.add_research_context(dense(spark, sf)))
    return rounded(made.select(
        "ts", signals.call_only_range_reversion(LOOSE["range_reversion"]).alias("call_only_range"), signals.moderate_vol_sweep_reversal(LOOSE["sweep_reversal"]).alias("moderate_sweep"),
        signals.call_only_range_reversion().alias("frozen_range"), signals.moderate_vol_sweep_reversal().alias("frozen_sweep")))


@query("signal_constants", f"WITH {bars_sql()} SELECT ts, 1::BIGINT AS up, -1::BIGINT AS down FROM b")
def signal_constants(spark, sf):
    return rounded(bars(spark, sf).select("ts", signals.always_call().alias("up"), signals.always_put().alias("down")))


@query("signal_from_probability", f"WITH {bars_sql()}, x AS (SELECT ts, CASE WHEN bar_idx % 7 > 0 THEN (bar_idx % 101) / 100.0::DOUBLE END AS p FROM b) SELECT ts, (CASE WHEN p >= 0.625 THEN 1 WHEN p <= 1 - 0.625::DOUBLE THEN -1 ELSE 0 END)::BIGINT AS signal FROM x")
def signal_from_probability(spark, sf):
    p = F.when(F.col("bar_idx") % 7 > 0, (F.col("bar_idx") % 101) / 100.0)
    return rounded(bars(spark, sf).withColumn("p", p).select("ts", signals.probability_signal("p", 0.625).alias("signal")))


EMA_X = ew_sql("x", "b", {"ef": ("close", 2 / 11, 10), "es": ("close", 2 / 31, 30)})


@query("signal_ema_crossover", f"""WITH RECURSIVE {bars_sql()}, {EMA_X}, y AS (SELECT ts, ef, es, {lag('ef')} AS pf, {lag('es')} AS ps FROM b JOIN x USING (bar_idx))
SELECT ts, ({side_sql('ef > es AND pf <= ps', 'ef < es AND pf >= ps')})::BIGINT AS signal FROM y""")
def signal_ema_crossover(spark, sf):
    return rounded(signals.add_ema_crossover(bars(spark, sf)).select("ts", "signal"))


@query("signal_rsi_reversal", f"""WITH RECURSIVE {core_sql()} SELECT ts, ({side_sql('rsi_14 > 40 AND prev_rsi_14 <= 40', 'rsi_14 < 60 AND prev_rsi_14 >= 60')})::BIGINT AS signal FROM f""")
def signal_rsi_reversal(spark, sf):
    return rounded(signals.add_rsi_reversal(bars(spark, sf), 14, 40, 60).select("ts", "signal"))


@query("signal_random_baseline", f"""WITH {bars_sql()} SELECT ts, CASE WHEN ('0x' || substr(md5(concat_ws('|', '7', 'ALL', bar_idx::VARCHAR)), 1, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END::BIGINT AS signal FROM b""")
def signal_random_baseline(spark, sf):
    return rounded(bars(spark, sf).select("ts", signals.random_baseline().alias("signal")))


# --- settlement and metrics --------------------------------------------------------------------------------------------------------------------------------

MOMENTUM = "sign(close - open)"


def momentum(b: DataFrame) -> DataFrame:
    return b.withColumn("signal", F.signum(F.col("close") - F.col("open")))


def trades_sql(minutes: int = 60, expiry: int = 3, offset: int = 1, payout: str = "0.82::DOUBLE", ties: str = "tie", by: str = "'ALL'") -> str:
    """CTEs up to `tr`, the trades of the momentum signal."""
    out = offset + expiry - 1
    w = "OVER (PARTITION BY series_id ORDER BY ts)"
    return f"""{bars_sql(minutes, by)}, s AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) {w} AS step FROM b
), iv AS (SELECT series_id, step AS iv FROM s WHERE step > 0 GROUP BY series_id, step QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY count(*) DESC, step) = 1
), k AS (SELECT s.*, sum(CASE WHEN step IS NULL OR step = iv THEN 0 ELSE 1 END) {w} AS breaks FROM s LEFT JOIN iv USING (series_id)
), l AS (SELECT *, {MOMENTUM}::INT AS direction, lead(ts, {offset}) {w} AS entry_ts, lead(ts, {out}) {w} AS exit_ts, lead(open, {offset}) {w} AS entry_price, lead(close, {out}) {w} AS exit_price,
  lead({payout}, {offset}) {w} AS payout, lead(breaks, {out}) {w} = breaks AS ok, bar_idx + {offset} AS entry_idx, bar_idx + {out} AS exit_idx FROM k
), v AS (SELECT *, ts AS signal_ts, CASE WHEN (exit_price - entry_price) * direction > 0 THEN 'win' WHEN (exit_price - entry_price) * direction < 0 THEN 'loss' ELSE '{ties}' END AS result FROM l
  WHERE direction <> 0 AND exit_ts IS NOT NULL AND ok
), tr AS MATERIALIZED (SELECT *, CASE result WHEN 'win' THEN payout WHEN 'loss' THEN -1.0 ELSE 0.0 END AS pnl, 1 / (1 + payout) AS break_even_win_rate FROM v)"""


def metrics_sql(source: str, by: list[str], path: bool = True) -> str:
    """A final SELECT of the metrics of a ledger by keys (not null)."""
    keys = ", ".join(by)
    pre = keys + ", " if by else ""
    part = f"PARTITION BY {keys} " if by else ""
    on = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in by) or "true"
    z = metrics.Z95
    bound = lambda sign: f"greatest(0.0, least(1.0, (p + {z * z} / (2 * n) {sign} {z} * sqrt((p * (1 - p) + {z * z} / (4 * n)) / n)) / (1 + {z * z} / n)))"
    cols = ["total_pnl", "expectancy", "win_rate"]
    head = f"""a AS (SELECT {pre}count(*) AS trades, count(*) FILTER (WHERE result = 'win') AS wins, count(*) FILTER (WHERE result = 'loss') AS losses, count(*) FILTER (WHERE result = 'tie') AS ties,
  coalesce(sum(pnl), 0.0) AS total_pnl, avg(pnl) AS expectancy FROM {source} {'GROUP BY ' + keys if by else ''}
), a2 AS (SELECT *, wins / nullif(wins + losses, 0)::DOUBLE AS p, nullif(wins + losses, 0)::DOUBLE AS n, wins / nullif(wins + losses, 0)::DOUBLE AS win_rate FROM a
), x AS (SELECT *, {bound('-')} AS wilson_low, {bound('+')} AS wilson_high FROM a2)"""
    select = f"{', '.join('x.' + k for k in by) + ', ' if by else ''}trades, wins, losses, ties, {r(*cols)}, CASE WHEN n IS NOT NULL THEN round(wilson_low, 6) + 0.0 END AS wilson_low, CASE WHEN n IS NOT NULL THEN round(wilson_high, 6) + 0.0 END AS wilson_high"
    if not path:
        return f"{head} SELECT {select} FROM x"
    return f"""{head}, e AS (SELECT *, sum(pnl) OVER o AS eq, row_number() OVER o AS rn, row_number() OVER (PARTITION BY {pre}result ORDER BY entry_ts, signal_ts) AS rr FROM {source}
  WINDOW o AS ({part}ORDER BY entry_ts, signal_ts ROWS UNBOUNDED PRECEDING)
), e2 AS (SELECT *, greatest(0.0, max(eq) OVER ({part}ORDER BY entry_ts, signal_ts ROWS UNBOUNDED PRECEDING)) - eq AS dd FROM e
), st AS (SELECT {pre}result, rn - rr AS g, count(*) AS len, max(dd) AS dd FROM e2 GROUP BY ALL
), y AS (SELECT {pre}coalesce(max(dd), 0.0) AS max_drawdown, coalesce(max(len) FILTER (WHERE result = 'loss'), 0) AS max_losing_streak, coalesce(max(len) FILTER (WHERE result = 'win'), 0) AS max_winning_streak FROM st {'GROUP BY ' + keys if by else ''})
SELECT {select}, round(max_drawdown, 6) + 0.0 AS max_drawdown, max_losing_streak, max_winning_streak FROM x JOIN y ON {on}"""


def hourly_trades(spark, sf, **changes) -> DataFrame:
    return settle(momentum(bars(spark, sf)), "signal", Settlement().but(**changes))


@query("hourly_momentum_settlement", f"WITH {trades_sql()}, {metrics_sql('tr', [])}")
def hourly_momentum_settlement(spark, sf):
    return rounded(metrics.metrics(hourly_trades(spark, sf)))


@query("five_minute_momentum_settlement", f"WITH {trades_sql(5)}, {metrics_sql('tr', [])}")
def five_minute_momentum_settlement(spark, sf):
    return rounded(metrics.metrics(settle(momentum(bars(spark, sf, 5)))))


TRADE_COLUMNS = ["entry_price", "exit_price", "payout", "break_even_win_rate", "pnl"]


@query("trade_ledger", f"WITH {trades_sql(5)} SELECT signal_ts, entry_ts, exit_ts, direction::BIGINT AS direction, result, {r(*TRADE_COLUMNS)} FROM tr")
def trade_ledger(spark, sf):
    return rounded(settle(momentum(bars(spark, sf, 5))).select("signal_ts", "entry_ts", "exit_ts", "direction", "result", *TRADE_COLUMNS))


@query("settlement_ties_lose", f"WITH {trades_sql(60, 1, 2, ties='loss')}, {metrics_sql('tr', [])}")
def settlement_ties_lose(spark, sf):
    return rounded(metrics.metrics(hourly_trades(spark, sf, expiry_bars=1, entry_offset_bars=2, tie_policy="loss")))


PAYOUT_SQL = "(0.7::DOUBLE + 0.01::DOUBLE * (bar_idx % 25))"


@query("settlement_payout_column", f"WITH {trades_sql(payout=PAYOUT_SQL)}, big AS (SELECT * FROM tr WHERE payout >= 0.8), {metrics_sql('big', [])}")
def settlement_payout_column(spark, sf):
    b = momentum(bars(spark, sf)).withColumn("payout", 0.7 + 0.01 * (F.col("bar_idx") % 25))
    return rounded(metrics.metrics(settle(b, "signal", Settlement(payout_column="payout", min_payout=0.8))))


def greedy_sql(cooldown: int) -> str:
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY entry_idx) AS n FROM tr), gr AS (
  SELECT 0::BIGINT AS n, -1::BIGINT AS last, false AS kept UNION ALL
  SELECT o.n, CASE WHEN o.entry_idx > gr.last + {cooldown} THEN o.exit_idx ELSE gr.last END, o.entry_idx > gr.last + {cooldown} FROM gr JOIN o ON o.n = gr.n + 1
), kp AS MATERIALIZED (SELECT o.* FROM o JOIN gr USING (n) WHERE gr.kept)"""


for _c in (0, 2):
    @query(f"settlement_no_overlap_cooldown_{_c}", f"WITH RECURSIVE {trades_sql()}, {greedy_sql(_c)}, {metrics_sql('kp', [])}")
    def _greedy(spark, sf, cooldown=_c):
        return rounded(metrics.metrics(hourly_trades(spark, sf, allow_overlap=False, cooldown_bars=cooldown)))


@query("direction_target", f"""WITH {trades_sql(5)}, x AS (SELECT ts, CASE WHEN ok AND exit_price > entry_price THEN 1.0 WHEN ok AND exit_price < entry_price THEN 0.0 END AS target_up FROM l)
SELECT coalesce(target_up, -1.0)::DOUBLE AS target_up, count(*) AS n FROM x GROUP BY ALL""")
def target_counts(spark, sf):
    rows = with_breaks(bars(spark, sf, 5)).select(F.coalesce(direction_target(3), F.lit(-1.0)).alias("target_up"))
    return rows.groupBy("target_up").agg(F.count(F.lit(1)).alias("n"))


@query("performance_by_direction", f"WITH {trades_sql()}, td AS (SELECT *, CASE WHEN direction = 1 THEN 'call' ELSE 'put' END AS side FROM tr), {metrics_sql('td', ['side'])}")
def performance_by_direction(spark, sf):
    return rounded(metrics.by_direction(hourly_trades(spark, sf)))


@query("performance_by_period", f"WITH {trades_sql()}, td AS (SELECT *, strftime(entry_ts, '%Y-%m-%d') AS period FROM tr), {metrics_sql('td', ['period'])}")
def performance_by_period(spark, sf):
    return rounded(metrics.by_period(hourly_trades(spark, sf), "D"))


@query("performance_by_series", f"WITH {trades_sql(by='event_type')}, {metrics_sql('tr', ['series_id'])}")
def performance_by_series(spark, sf):
    return rounded(metrics.metrics(settle(momentum(bars(spark, sf, 60, True))), ["series_id"]))


def _context(spark, sf) -> DataFrame:
    made = context.add_regime(context.add_utc_context(context.add_volatility_context(bars(spark, sf))))
    return made.withColumn("volatility_bucket", metrics.volatility_bucket())


def enriched(spark, sf) -> DataFrame:
    return joins.enrich_at_signal(hourly_trades(spark, sf), _context(spark, sf), ["utc_window", "market_regime", "volatility_bucket"])


BUCKET_SQL = "CASE WHEN atr_percentile_100 <= 0.25 THEN 'q1_low' WHEN atr_percentile_100 <= 0.5 THEN 'q2_mid_low' WHEN atr_percentile_100 <= 0.75 THEN 'q3_mid_high' WHEN atr_percentile_100 > 0.75 THEN 'q4_high' END"
WINDOW_SQL = "CASE WHEN utc_hour <= 6 THEN '00_06' WHEN utc_hour <= 11 THEN '07_11' WHEN utc_hour <= 16 THEN '12_16' WHEN utc_hour <= 20 THEN '17_20' ELSE '21_23' END"
ENRICHED_SQL = f"""{core_sql()}, {trades_sql()[len(bars_sql()) + 2:]}, td AS MATERIALIZED (
  SELECT tr.*, cx.utc_window, cx.market_regime, cx.volatility_bucket FROM tr LEFT JOIN (SELECT ts AS cts, {WINDOW_SQL} AS utc_window, {REGIME_SQL} AS market_regime, {BUCKET_SQL} AS volatility_bucket FROM f) cx ON cx.cts = tr.signal_ts)"""


@query("performance_breakdown", f"WITH RECURSIVE {ENRICHED_SQL}, q0 AS ({metrics_sql('td', ['market_regime', 'volatility_bucket']).replace('a AS (', 'WITH a AS (', 1)}) SELECT * FROM q0 WHERE trades >= 5")
def performance_breakdown(spark, sf):
    return rounded(metrics.breakdown(enriched(spark, sf), ["market_regime", "volatility_bucket"], 5))


@query("dimension_breakdown", f"""WITH RECURSIVE {ENRICHED_SQL}, dm AS (SELECT 'market_regime' AS dimension, market_regime AS value, result, pnl FROM td UNION ALL SELECT 'utc_window', utc_window, result, pnl FROM td),
{metrics_sql('dm', ['dimension', 'value'], path=False)}""")
def dimension_breakdown(spark, sf):
    return rounded(metrics.grouping_breakdown(enriched(spark, sf), ["market_regime", "utc_window"]))


# --- joins and consolidation -------------------------------------------------------------------------------------------------------------------------------


def observations(spark, sf) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'purchase'")
    share = F.get_json_object("props", "$.k").cast("double") / 100
    return e.select(F.concat(F.lit("A"), (F.col("user_id") % 3).cast("string")).alias("asset"), F.col("ts").alias("observed_at"), share.alias("payout"))


@query("payouts_as_of", """WITH o AS (SELECT 'A' || (user_id % 3) AS asset, ts AS observed_at, json_extract_string(props, '$.k')::DOUBLE / 100 AS payout FROM events WHERE event_type = 'purchase'
), e AS (SELECT event_id, 'A' || (user_id % 3) AS asset, ts FROM events WHERE event_type = 'click'
), j AS (SELECT e.*, o.observed_at, o.payout, (epoch_us(e.ts) - epoch_us(o.observed_at)) / 1e6 AS age FROM e ASOF LEFT JOIN o ON e.asset = o.asset AND e.ts >= o.observed_at)
SELECT event_id, asset, ts, CASE WHEN age <= 1800 THEN round(payout, 6) END AS payout, CASE WHEN age <= 1800 THEN round(age, 6) END AS payout_age_seconds FROM j""")
def payouts_as_of(spark, sf):
    clicks = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'click'").select("event_id", F.concat(F.lit("A"), (F.col("user_id") % 3).cast("string")).alias("asset"), "ts")
    return rounded(joins.asof_backward(clicks, observations(spark, sf), 1800).drop("observed_at"))


@query("provider_agreement", """WITH t AS (SELECT ts, event_type, value AS px FROM events), b AS (
  SELECT event_type, time_bucket(INTERVAL '60 minutes', ts) AS ts, arg_min(px, ts) AS open, arg_max(px, ts) AS close FROM (SELECT ts, event_type, ((px + 0.01::DOUBLE) + (px - 0.01::DOUBLE)) / 2 AS px FROM t) GROUP BY ALL
) SELECT count(*) AS shared, round(avg(abs(x.close - y.close)), 6) AS mean_close_deviation, round(max(abs(x.close - y.close)), 6) AS max_close_deviation,
  round(avg((sign(x.close - x.open) = sign(y.close - y.open))::INT), 6) AS direction_agreement FROM b x JOIN b y USING (ts) WHERE x.event_type = 'click' AND y.event_type = 'view'""")
def provider_agreement(spark, sf):
    b = bars(spark, sf, 60, True)
    return rounded(joins.agreement(b.filter("series_id = 'click'"), b.filter("series_id = 'view'")))


SNAP_SQL = f"""{bars_sql()}, u AS (SELECT 0 AS snapshot, ts, open, high, low, close FROM b WHERE bar_idx < 400
  UNION ALL SELECT 1, ts, open, high + CASE WHEN bar_idx % 50 = 0 THEN 1 ELSE 0 END, low, close FROM b WHERE bar_idx >= 300)"""


def snapshots(spark, sf) -> list[DataFrame]:
    b = bars(spark, sf)
    late = b.filter("bar_idx >= 300").withColumn("high", F.col("high") + F.when(F.col("bar_idx") % 50 == 0, 1.0).otherwise(0.0))
    return [x.select("ts", *PRICES) for x in (b.filter("bar_idx < 400"), late)]


@query("snapshot_conflicts", f"WITH {SNAP_SQL} SELECT ts, count(*) AS n FROM u GROUP BY ts HAVING max(high) <> min(high)")
def snapshot_conflicts(spark, sf):
    return consolidate.conflicts(consolidate.union_snapshots(snapshots(spark, sf)))


@query("snapshot_consolidation", f"WITH {SNAP_SQL} SELECT ts, {r(*PRICES)} FROM u QUALIFY row_number() OVER (PARTITION BY ts ORDER BY snapshot DESC) = 1")
def snapshot_consolidation(spark, sf):
    return rounded(consolidate.consolidate(snapshots(spark, sf), "prefer_last"))


# --- simulation and stress ---------------------------------------------------------------------------------------------------------------------------------


def index_sql(text: str, n: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT % {n}"


PNL_SQL = "pp AS MATERIALIZED (SELECT row_number() OVER (ORDER BY entry_ts, signal_ts) - 1 AS pos, pnl, count(*) OVER () AS n FROM tr)"
SUMMARY = "count(*) AS simulations, round(quantile_cont(m, 0.025), 6) AS p2_5, round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(m, 0.975), 6) AS p97_5, round(avg((m > 0)::INT), 6) AS probability_positive"
def draws_sql(simulations: int) -> str:
    return f"""d0 AS (SELECT s.sim, d.draw, {index_sql("concat_ws('|', '42', s.sim::VARCHAR, d.draw::VARCHAR)", 'd.n')} AS pos
  FROM range({simulations}) s(sim) CROSS JOIN (SELECT unnest(range(n)) AS draw, n FROM (SELECT any_value(n) AS n FROM pp)) d), dr AS (SELECT sim, draw, pnl FROM d0 JOIN pp USING (pos))"""


@query("bootstrap_expectancy", f"WITH {trades_sql()}, {PNL_SQL}, {draws_sql(10_000)}, sm AS (SELECT avg(pnl) AS m FROM dr GROUP BY sim) SELECT {SUMMARY} FROM sm")
def bootstrap(spark, sf):
    return rounded(resample.bootstrap_expectancy(hourly_trades(spark, sf)))


@query("block_bootstrap_expectancy", f"""WITH {trades_sql()}, {PNL_SQL}, bl AS (SELECT s.sim, k.blk, k.n, {index_sql("concat_ws('|', '42', s.sim::VARCHAR, k.blk::VARCHAR)", '(k.n - 19)')} AS st
  FROM range(10000) s(sim), (SELECT unnest(range(CAST(ceil(n / 20) AS BIGINT))) AS blk, n FROM (SELECT any_value(n) AS n FROM pp)) k
), sm AS (SELECT sum(pnl) / any_value(bl.n) AS m FROM bl JOIN pp ON pp.pos >= st AND pp.pos < st + least(20, bl.n - blk * 20) GROUP BY sim) SELECT {SUMMARY} FROM sm""")
def block_bootstrap(spark, sf):
    return rounded(resample.block_bootstrap_expectancy(hourly_trades(spark, sf), 20))


@query("monte_carlo", f"""WITH {trades_sql()}, {PNL_SQL}, {draws_sql(5_000)}, eq AS (SELECT *, sum(pnl) OVER (PARTITION BY sim ORDER BY draw ROWS UNBOUNDED PRECEDING) AS e FROM dr
), fl AS (SELECT *, greatest(0.0, max(e) OVER (PARTITION BY sim ORDER BY draw ROWS UNBOUNDED PRECEDING)) - e AS dd FROM eq
), sm AS (SELECT sum(pnl) AS fin, max(dd) AS dd FROM fl GROUP BY sim)
SELECT count(*) AS simulations, {', '.join(f"round(quantile_cont({c}, {p}), 6) AS {k}{n}" for c, k in (('fin', 'pnl_'), ('dd', 'drawdown_')) for p, n in ((0.025, 'p2_5'), (0.5, 'median'), (0.975, 'p97_5')))},
  round(avg((fin > 0)::INT), 6) AS probability_profit FROM sm""")
def monte_carlo(spark, sf):
    return rounded(resample.monte_carlo(hourly_trades(spark, sf)))


@query("payout_sensitivity", f"""WITH {trades_sql()}, rp AS (SELECT entry_ts, signal_ts, result, q AS scenario_payout, CASE result WHEN 'win' THEN q WHEN 'loss' THEN -1.0 ELSE 0.0 END AS pnl
  FROM tr, (SELECT unnest([0.7, 0.75, 0.8, 0.82, 0.85, 0.9, 0.92]::DOUBLE[]) AS q)), z AS ({metrics_sql('rp', ['scenario_payout']).replace('a AS (', 'WITH a AS (', 1)})
SELECT *, round(1 / (1 + scenario_payout), 6) AS break_even_win_rate FROM z""")
def payout_sensitivity(spark, sf):
    return rounded(resample.payout_sensitivity(hourly_trades(spark, sf)))
