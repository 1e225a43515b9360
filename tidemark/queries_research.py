"""Queries of search, walk-forward, stress and models, and the same results in SQL."""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import functions as F

from tidemark.functions import context, indicators, signals
from tidemark.operators import joins, resample
from tidemark.operators.settle import Settlement
from tidemark.plans import boosting, models, search
from tidemark.queries import (
    EMA_X, MOMENTUM, ORACLE_SQL, QUERIES, STEPS, bars, bars_sql, core_sql, dense, inputs_sql, lag, metrics_sql, momentum, query, r, research_sql, rounded, rule_sql, side_sql, trades_sql,
)
from tidemark.schemas import PRICES
from tidemark.session import written

# --- one pass over several settlements ---------------------------------------------------------------------------------------------------------------------


def settled_sql(name: str, source: str, expiry: int, offset: int, direction: str, by: str = "") -> str:
    """CTE `name`: trades of a direction over a source with bar_idx and breaks."""
    out = offset + expiry - 1
    w = f"OVER ({'PARTITION BY ' + by if by else ''} ORDER BY ts)"
    return f"""{name}0 AS (SELECT *, ({direction})::INT AS direction, lead(ts, {offset}) {w} AS entry_ts, lead(ts, {out}) {w} AS exit_ts, lead(open, {offset}) {w} AS entry_price,
  lead(close, {out}) {w} AS exit_price, lead(breaks, {out}) {w} = breaks AS ok, bar_idx + {offset} AS entry_idx, bar_idx + {out} AS exit_idx, ts AS signal_ts FROM {source}
), {name}1 AS (SELECT *, CASE WHEN (exit_price - entry_price) * direction > 0 THEN 'win' WHEN (exit_price - entry_price) * direction < 0 THEN 'loss' ELSE 'tie' END AS result
  FROM {name}0 WHERE direction <> 0 AND exit_ts IS NOT NULL AND ok
), {name} AS MATERIALIZED (SELECT *, CASE result WHEN 'win' THEN 0.82::DOUBLE WHEN 'loss' THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS pnl FROM {name}1)"""


def greedy(name: str, source: str, cooldown: int) -> str:
    """CTE `name`: the trades of source that are taken one after the other."""
    return f"""{name}o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY entry_idx) AS n FROM {source}), {name}g AS (
  SELECT 0::BIGINT AS n, -1::BIGINT AS last, false AS kept UNION ALL
  SELECT o.n, CASE WHEN o.entry_idx > g.last + {cooldown} THEN o.exit_idx ELSE g.last END, o.entry_idx > g.last + {cooldown} FROM {name}g g JOIN {name}o o ON o.n = g.n + 1
), {name} AS MATERIALIZED (SELECT o.* FROM {name}o o JOIN {name}g g USING (n) WHERE g.kept)"""


PLANS = [(o, a, x) for o in (1, 2) for a, x in ((True, 0), (False, 0), (False, 1))]
_TAKEN = [f"w{o}" if a else f"g{o}{x}" for o, a, x in PLANS]
METRIC_COLUMNS = ["trades", "wins", "losses", "ties", "total_pnl", "expectancy", "win_rate", "wilson_low", "wilson_high", "max_drawdown", "max_losing_streak", "max_winning_streak"]


@query("execution_sensitivity", f"""WITH RECURSIVE {bars_sql()}, {STEPS}, {', '.join(settled_sql(f'w{o}', 'k', 3, o, MOMENTUM) for o in (1, 2))},
{', '.join(greedy(f'g{o}{x}', f'w{o}', x) for o, a, x in PLANS if not a)}, ev AS ({' UNION ALL '.join(
    f"SELECT {o}::BIGINT AS o, {a}::INT AS a, {x}::BIGINT AS c, entry_ts, signal_ts, result, pnl FROM {t}" for (o, a, x), t in zip(PLANS, _TAKEN))}
), z AS ({metrics_sql('ev', ['o', 'a', 'c']).replace('a AS (', 'WITH a AS (', 1)}), pl(o, a, c) AS (VALUES {', '.join(f'({o}, {int(a)}, {x})' for o, a, x in PLANS)})
SELECT pl.o::BIGINT AS "offset", pl.a::INT AS overlap, pl.c::BIGINT AS cooldown, {', '.join(f"coalesce(z.{n}, 0) AS {n}" if n in ('trades', 'wins', 'losses', 'ties', 'total_pnl', 'max_drawdown', 'max_losing_streak', 'max_winning_streak') else f"z.{n}" for n in METRIC_COLUMNS)}
FROM pl LEFT JOIN z ON z.o = pl.o AND z.a = pl.a AND z.c = pl.c""")
def execution_sensitivity(spark, sf):
    return rounded(resample.execution_sensitivity(momentum(bars(spark, sf))))


def sliced_sql(low: str, high: str, only: str = "true", source: str | None = None) -> str:
    """CTEs up to `b`: the bars with numbers in [low, high), expressions over their number n, numbered anew."""
    whole = (source or bars_sql()).replace("b AS MATERIALIZED", "ba AS MATERIALIZED")
    return f"""{whole}, bn AS (SELECT count(*) AS n FROM ba), b AS MATERIALIZED (
  SELECT ba.* REPLACE ((bar_idx - ({low}))::BIGINT AS bar_idx) FROM ba, bn WHERE bar_idx >= {low} AND bar_idx < {high} AND {only})"""


FIRST, SECOND = "floor(n * 0.6::DOUBLE)", "(floor(n * 0.6::DOUBLE) + floor(n * 0.2::DOUBLE))"
SLICES = {"development": ("0", FIRST), "validation": (FIRST, SECOND), "locked": (SECOND, "n")}
V1 = {"adx_min": 20.0, "atr_pct_min": 0.15, "atr_pct_max": 0.90, "ema_distance_atr": 0.45, "rsi_trigger": 50.0}
RULES = {
    "always_call": "1", "always_put": "-1",
    "random": "CASE WHEN ('0x' || substr(md5(concat_ws('|', '7', 'ALL', bar_idx::VARCHAR)), 1, 8))::BIGINT % 2 = 0 THEN 1 ELSE -1 END",
    "ema_crossover": side_sql("ef > es AND pef <= pes", "ef < es AND pef >= pes"),
    "rsi_reversal": side_sql("rsi_14 > 30 AND prev_rsi_14 <= 30", "rsi_14 < 70 AND prev_rsi_14 >= 70"),
    "trend_pullback_v1": side_sql(*rule_sql("trend_pullback", V1)),
}


def _benchmark_slice(name: str) -> str:
    pick = "CASE strategy " + " ".join(f"WHEN '{n}' THEN {x}" for n, x in RULES.items()) + " END"
    return f"""SELECT '{name}' AS slice, strategy, entry_ts, signal_ts, result, pnl FROM (WITH RECURSIVE {core_sql(source=sliced_sql(*SLICES[name]))}, {EMA_X}, fe AS (
  SELECT f.*, ef, es, lag(ef) OVER (ORDER BY ts) AS pef, lag(es) OVER (ORDER BY ts) AS pes FROM f JOIN x USING (bar_idx)
), {STEPS.replace('FROM b', 'FROM fe')}, ks AS (SELECT k.*, strategy FROM k, (VALUES {', '.join(f"('{n}')" for n in RULES)}) v(strategy)),
{settled_sql('w', 'ks', 3, 1, pick, 'strategy')} SELECT * FROM w)"""


@query("benchmark_strategies", f"WITH al AS ({' UNION ALL '.join(map(_benchmark_slice, SLICES))}), {metrics_sql('al', ['strategy', 'slice'])}")
def benchmark_strategies(spark, sf):
    return rounded(search.benchmark_strategies(bars(spark, sf), signals.STRATEGIES))


# --- search ------------------------------------------------------------------------------------------------------------------------------------------------


@query("chronological_split", f"""WITH {bars_sql()}, x AS (SELECT *, count(*) OVER () AS n FROM b)
SELECT CASE WHEN bar_idx < {FIRST} THEN 'development' WHEN bar_idx < {SECOND} THEN 'validation' ELSE 'locked' END AS slice, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM x GROUP BY ALL""")
def chronological_split(spark, sf):
    return search.split_slices(bars(spark, sf)).groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


GRID = {"adx_max": (95.0, 100.0), "rsi_lower": (40.0, 48.0), "rsi_upper": (52.0, 60.0), "band_buffer_atr": (0.6, 1.2), "atr_pct_max": (0.70, 0.95)}
VARIANTS = [search.Variant(1), search.Variant(3), search.Variant(3, 2)]
FAMILY = signals.Family("range_reversion", signals.range_reversion, indicators.add_core_features, GRID)
EXPIRIES = [search.Variant(e) for e in (1, 2, 3, 5)]


def grid_table(grid) -> str:
    """CTE `g`: candidate, params and a column p_<name> per parameter."""
    text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
    rows = [f"({i}, '{json.dumps(x, sort_keys=True)}', {', '.join(map(text, x.values()))})" for i, x in enumerate(search.parameter_sets(grid))]
    return f"g(candidate, params, {', '.join('p_' + k for k in grid)}) AS (VALUES {', '.join(rows)})"


def cells_sql(family: str, grid, variants, source: str) -> str:
    """CTEs up to `mt`: the order-free metrics of every candidate and variant that trades, over a source of features."""
    cells = " UNION ALL ".join(
        f"SELECT {i} AS variant, k.*, lead(open, {v.entry_offset_bars}) OVER (ORDER BY ts) AS en, lead(close, {v.entry_offset_bars + v.expiry_bars - 1}) OVER (ORDER BY ts) AS ex, "
        f"lead(breaks, {v.entry_offset_bars + v.expiry_bars - 1}) OVER (ORDER BY ts) = breaks AS ok FROM k" for i, v in enumerate(variants))
    return f"""{grid_table(grid)}, {STEPS.replace('FROM b', f'FROM {source}')}, ce AS ({cells}
), sg AS (SELECT candidate, params, variant, en, ex, {side_sql(*rule_sql(family, {k: 'p_' + k for k in grid}))} AS dir FROM ce, g WHERE ok
), rs AS (SELECT candidate, params, variant, CASE WHEN (ex - en) * dir > 0 THEN 'win' WHEN (ex - en) * dir < 0 THEN 'loss' ELSE 'tie' END AS result FROM sg WHERE dir <> 0
), pn AS (SELECT *, CASE result WHEN 'win' THEN 0.82 WHEN 'loss' THEN -1.0 ELSE 0.0 END::DOUBLE AS pnl FROM rs),
mt AS ({metrics_sql('pn', ['candidate', 'params', 'variant'], path=False).replace('a AS (', 'WITH a AS (', 1)})"""


def ranked_sql(variants, min_trades: int) -> str:
    """CTE `rk`: every candidate and variant with score and position."""
    return f"""rk AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS LAST, candidate, variant) AS position FROM (
  SELECT g.candidate::BIGINT AS candidate, vv.variant::BIGINT AS variant, coalesce(trades, 0) AS trades, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(ties, 0) AS ties,
    expectancy, wilson_low, CASE WHEN trades >= {min_trades} THEN wilson_low END AS score
  FROM g CROSS JOIN range({len(variants)}) vv(variant) LEFT JOIN mt ON mt.candidate = g.candidate AND mt.variant = vv.variant))"""


FOUND = ["candidate", "variant", "trades", "wins", "losses", "expectancy", "wilson_low", "score", "position"]


@query("grid_search_matrix", f"WITH RECURSIVE {core_sql()}, {cells_sql('range_reversion', GRID, VARIANTS, 'f')}, {ranked_sql(VARIANTS, 5)} SELECT {', '.join(FOUND)} FROM rk")
def grid_search_matrix(spark, sf):
    return rounded(search.grid_search_matrix(FAMILY.prepared(bars(spark, sf)), FAMILY, VARIANTS, "wilson_low", 5).select(*FOUND))


for _name, _family in signals.FAMILIES.items():
    @query(f"grid_search_{_name}", f"WITH RECURSIVE {research_sql()}, {cells_sql(_name, _family.grid, EXPIRIES, 'fx')}, {ranked_sql(EXPIRIES, 5)} SELECT {', '.join(FOUND)} FROM rk")
    def _grid(spark, sf, family=_family):
        """The family's own grid at the four expiries."""
        return rounded(search.grid_search_matrix(family.prepared(dense(spark, sf)), family, EXPIRIES, "wilson_low", 5).select(*FOUND))


@query("parameter_grids", f"""WITH {bars_sql()} SELECT family, size, size * (SELECT count(*) FROM b) AS evaluations FROM (
  VALUES ('trend_pullback', 288::BIGINT), ('range_reversion', 288), ('breakout', 192), ('htf_aligned_pullback', 72), ('compression_breakout', 32), ('sweep_reversal', 48)) t(family, size)""")
def parameter_grids(spark, sf):
    """Sets of each family's grid, and how often a search over the bars evaluates one."""
    tables = [search.parameter_table(spark, f.grid).select(F.lit(f.name).alias("family")) for f in signals.FAMILIES.values()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    sizes = out.groupBy("family").agg(F.count(F.lit(1)).alias("size"))
    return sizes.crossJoin(F.broadcast(bars(spark, sf).agg(F.count(F.lit(1)).alias("bars")))).select("family", "size", (F.col("size") * F.col("bars")).alias("evaluations"))


@query("evidence_gate", f"""WITH {trades_sql()}, td AS (SELECT *, hour(entry_ts)::BIGINT AS h FROM tr), z AS ({metrics_sql('td', ['h'], path=False).replace('a AS (', 'WITH a AS (', 1)})
SELECT h, coalesce(wins + losses >= 10 AND expectancy > 0 AND wilson_low > 1 / 1.82, false)::INT AS passed FROM z""")
def evidence_gate(spark, sf):
    from tidemark.operators.metrics import metrics
    from tidemark.operators.settle import settle

    found = metrics(settle(momentum(bars(spark, sf))).withColumn("h", F.hour("entry_ts").cast("long")), ["h"])
    return rounded(found.select("h", search.evidence_gate(10, 0.82).alias("passed")))


@query("walk_forward_windows", f"""WITH {bars_sql()}, x AS (SELECT *, count(*) OVER () AS n FROM b), w AS (SELECT unnest(range(0, (any_value(n) - 300) // 100 + 1)) AS window_id FROM x)
SELECT window_id, CASE WHEN bar_idx - window_id * 100 < 200 THEN 'train' ELSE 'test' END AS role, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
FROM w JOIN x ON bar_idx >= window_id * 100 AND bar_idx < window_id * 100 + 300 GROUP BY ALL""")
def walk_forward_windows(spark, sf):
    w = search.walk_forward_windows(bars(spark, sf), 200, 100)
    return rounded(w.groupBy("window_id", "role").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


def cells_of(source: str, tag: str, variants) -> str:
    """The metrics of the small grid over bars of their own, as a subquery."""
    return f"SELECT {tag}, mt.* FROM (WITH RECURSIVE {core_sql(source=source)}, {cells_sql('range_reversion', GRID, variants, 'f')} SELECT * FROM mt) mt"


def _windows_sql(train: int, test: int) -> str:
    """Windows start every `test` bars; the bars span a month of hours, which has two windows at most."""
    every = []
    for w in range(2):
        only = f"{w} <= floor((n - {train + test}) / {test})"
        for role, lo, hi in (("train", 0, train), ("test", train, train + test)):
            every.append(cells_of(sliced_sql(str(w * test + lo), str(w * test + hi), only), f"{w} AS window_id, '{role}' AS role", [search.Variant(3)]))
    return " UNION ALL ".join(every)


@query("walk_forward", f"""WITH al AS MATERIALIZED ({_windows_sql(400, 150)}), bs AS (SELECT * FROM al WHERE role = 'train' AND trades >= 3 QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY wilson_low DESC, candidate) = 1)
SELECT 'ALL' AS series_id, window_id::BIGINT AS window_id, bs.candidate::BIGINT AS candidate, bs.params, bs.wilson_low AS train_score, bs.trades AS train_trades, coalesce(t.trades, 0) AS trades, coalesce(t.wins, 0) AS wins,
  coalesce(t.losses, 0) AS losses, coalesce(t.ties, 0) AS ties, t.expectancy, t.win_rate, t.wilson_low FROM bs LEFT JOIN (SELECT * FROM al WHERE role = 'test') t USING (window_id, candidate)""")
def walk_forward(spark, sf):
    return rounded(search.walk_forward(bars(spark, sf), FAMILY, search.Variant(3), 400, 150, objective="wilson_low", min_trades=3))


@query("gated_experiment", f"""WITH al AS MATERIALIZED ({' UNION ALL '.join(cells_of(sliced_sql(*SLICES[x]), f"'{x}' AS slice", VARIANTS) for x in SLICES)}
), bs AS (SELECT candidate, variant FROM al WHERE slice = 'development' AND trades >= 3 ORDER BY wilson_low DESC, candidate, variant LIMIT 1
), va AS (SELECT coalesce(al.trades, 0) AS trades, al.expectancy, al.wilson_low FROM bs LEFT JOIN al ON al.slice = 'validation' AND al.candidate = bs.candidate AND al.variant = bs.variant
), lo AS (SELECT coalesce(al.trades, 0) AS trades FROM bs LEFT JOIN al ON al.slice = 'locked' AND al.candidate = bs.candidate AND al.variant = bs.variant)
SELECT CASE WHEN va.trades IS NULL THEN 'no_development_candidate' WHEN va.trades < 3 OR coalesce(va.expectancy, 0) <= -1 OR coalesce(va.wilson_low, 0) <= 0 THEN 'rejected_validation'
  WHEN lo.trades >= 3 THEN 'tested' ELSE 'insufficient_locked_test' END AS status, va.trades AS validation_trades, round(va.expectancy, 6) AS validation_expectancy
FROM (SELECT 1) one LEFT JOIN va ON true LEFT JOIN lo ON true""")
def gated_experiment(spark, sf):
    out = search.run_experiment(bars(spark, sf), FAMILY, VARIANTS, search.Gate(3, -1.0, 0.0), "wilson_low", 3, 3)
    m = out.get("validation") or {}
    expectancy = m.get("expectancy")
    return spark.createDataFrame([(out["status"], m.get("trades"), expectancy if expectancy is None else round(expectancy, 6))], "status string, validation_trades long, validation_expectancy double")


@query("signal_by_index", f"WITH {bars_sql()} SELECT ts, (CASE WHEN bar_idx % 5 = 0 THEN {MOMENTUM} ELSE 0 END)::BIGINT AS signal FROM b")
def signal_by_index(spark, sf):
    b = bars(spark, sf)
    some = momentum(b).filter("bar_idx % 5 = 0").select("series_id", "slice", "bar_idx", F.col("signal").cast("int").alias("signal"))
    return rounded(joins.signal_by_index(b, some).select("ts", "signal"))


# --- models ------------------------------------------------------------------------------------------------------------------------------------------------

#: A logistic model of fixed numbers, so that SQL can score it too.
GIVEN = models.LogisticModel(("return_1", "rsi_14", "adx_14", "htf_5_return_1"), (0.0, 50.0, 25.0, 0.0), (0.5, 20.0, 10.0, 0.5), (-0.9, -0.35, 0.15, 0.4), 0.02)
GIVEN_P = f"1 / (1 + exp(-(0.02::DOUBLE + {' + '.join(f'({w}::DOUBLE * ({f} - {m}::DOUBLE) / {s}::DOUBLE)' for f, m, s, w in zip(GIVEN.features, GIVEN.mean, GIVEN.scale, GIVEN.weights))})))"
SCORED_SQL = f"""{research_sql()}, {STEPS.replace('FROM b', 'FROM fx')}, kp AS MATERIALIZED (SELECT *, {GIVEN_P} AS p FROM (SELECT *, close / nullif({lag('close')}, 0) - 1 AS return_1 FROM k))"""


def given(spark, sf):
    rows = models.prepare(context.add_ml_features(dense(spark, sf)), 3, 1, list(GIVEN.features))
    return GIVEN.transform(rows)


@query("model_targets", f"""WITH RECURSIVE {SCORED_SQL}, l AS (SELECT *, lead(open, 1) OVER (ORDER BY ts) AS en, lead(close, 3) OVER (ORDER BY ts) AS ex, lead(breaks, 3) OVER (ORDER BY ts) = breaks AS ok FROM kp)
SELECT ts, (p IS NOT NULL)::INT AS eligible, CASE WHEN ok AND ex > en THEN 1.0 WHEN ok AND ex < en THEN 0.0 END::DOUBLE AS target_up, round(p, 6) AS probability_up FROM l""")
def model_targets(spark, sf):
    return rounded(given(spark, sf).select("ts", "eligible", "target_up", "probability_up"))


@query("target_counts", f"""WITH RECURSIVE {SCORED_SQL}, l AS (SELECT *, lead(open, 1) OVER (ORDER BY ts) AS en, lead(close, 3) OVER (ORDER BY ts) AS ex, lead(breaks, 3) OVER (ORDER BY ts) = breaks AS ok FROM kp)
SELECT (p IS NOT NULL)::INT AS eligible, CASE WHEN ok AND ex > en THEN 1.0 WHEN ok AND ex < en THEN 0.0 ELSE -1.0 END::DOUBLE AS target, count(*) AS n FROM l GROUP BY ALL""")
def target_counts_by_eligibility(spark, sf):
    return rounded(given(spark, sf).groupBy("eligible", F.coalesce("target_up", F.lit(-1.0)).alias("target")).agg(F.count(F.lit(1)).alias("n")))


@query("model_thresholds", f"""WITH RECURSIVE {SCORED_SQL}, kt AS (SELECT kp.*, threshold FROM kp, (VALUES (0.51::DOUBLE), (0.55), (0.575), (0.6), (0.625), (0.65)) v(threshold)),
{settled_sql('w', 'kt', 3, 1, 'CASE WHEN p >= threshold THEN 1 WHEN p <= 1 - threshold THEN -1 ELSE 0 END', 'threshold')}, z AS ({metrics_sql('w', ['threshold']).replace('a AS (', 'WITH a AS (', 1)})
SELECT *, CASE WHEN trades >= 20 AND expectancy > -0.5 THEN wilson_low END AS score FROM z""")
def model_thresholds(spark, sf):
    return rounded(models.threshold_scores(given(spark, sf), Settlement(3), (0.51, *models.THRESHOLDS), "wilson_low", 20, -0.5))


CELLS = (1, 3, 5)


def _cells_sql(expiry: int) -> str:
    settled = settled_sql(f"w{expiry}", "kt", expiry, 1, "CASE WHEN p >= threshold THEN 1 WHEN p <= 1 - threshold THEN -1 ELSE 0 END", "threshold")
    return f"{settled}, z{expiry} AS ({metrics_sql(f'w{expiry}', ['threshold']).replace('a AS (', 'WITH a AS (', 1)})"


_CELLS_SQL = f"""WITH RECURSIVE {SCORED_SQL}, kt AS (SELECT kp.*, threshold FROM kp, (VALUES (0.51::DOUBLE), (0.55), (0.575), (0.6), (0.625), (0.65)) v(threshold)), {', '.join(map(_cells_sql, CELLS))},
al AS ({' UNION ALL '.join(f'SELECT {e}::BIGINT AS expiry_bars, threshold, trades, expectancy, wilson_low FROM z{e}' for e in CELLS)}), ok AS (SELECT * FROM al WHERE trades >= 20 AND expectancy > -0.5 AND wilson_low IS NOT NULL)"""


def cells(spark, sf):
    out = None
    for e in CELLS:
        rows = GIVEN.transform(models.prepare(context.add_ml_features(dense(spark, sf)), e, 1, list(GIVEN.features)))
        made = models.threshold_scores(rows, Settlement(e), (0.51, *models.THRESHOLDS), "wilson_low", 20, -0.5).withColumn("expiry_bars", F.lit(e))
        out = made if out is None else out.unionByName(made)
    return out


@query("model_cells_ranked", f"{_CELLS_SQL} SELECT row_number() OVER (ORDER BY wilson_low DESC, expiry_bars, threshold DESC) AS rank, expiry_bars, threshold, trades, wilson_low FROM ok")
def model_cells_ranked(spark, sf):
    """Development cells of a given model, in the protocol's order of three keys."""
    return rounded(models.ranked_cells(cells(spark, sf)).select("rank", "expiry_bars", "threshold", "trades", "wilson_low"))


@query("model_threshold_choice", f"{_CELLS_SQL} SELECT expiry_bars, arg_max(threshold, (wilson_low, threshold)) AS threshold FROM ok GROUP BY expiry_bars")
def model_threshold_choice(spark, sf):
    """The best threshold of each expiry, the higher of equals."""
    scores = written(cells(spark, sf), "cells")
    found = [(e, models.best_threshold(scores.filter(F.col("expiry_bars") == e))) for e in CELLS]
    return spark.createDataFrame([x for x in found if x[1] is not None], "expiry_bars long, threshold double")


@query("frozen_evaluation", f"""WITH RECURSIVE {SCORED_SQL}, {settled_sql('w', 'kp', 3, 1, 'CASE WHEN p >= 0.625 THEN 1 WHEN p <= 1 - 0.625::DOUBLE THEN -1 ELSE 0 END')}, {metrics_sql('w', [])}""")
def frozen_evaluation(spark, sf):
    """The frozen expiry and threshold over a model of given numbers."""
    rows = models.prepare(context.add_ml_features(dense(spark, sf)), models.FROZEN_EXPIRY, 1, list(GIVEN.features))
    return rounded(models.evaluate(GIVEN, rows, models.FROZEN_THRESHOLD, Settlement(models.FROZEN_EXPIRY)))


@query("model_coefficients", f"""WITH RECURSIVE {SCORED_SQL} {' UNION ALL '.join(
    f"SELECT {i}::BIGINT AS rank, '{f}' AS feature, {w}::DOUBLE AS weight, round(avg(abs({w}::DOUBLE * ({f} - {dict(zip(GIVEN.features, GIVEN.mean))[f]}::DOUBLE) / {dict(zip(GIVEN.features, GIVEN.scale))[f]}::DOUBLE)), 6) AS mean_effect FROM kp WHERE p IS NOT NULL"
    for i, (f, w) in enumerate(GIVEN.coefficients(), 1))}""")
def model_coefficients(spark, sf):
    """Coefficients by weight, and the mean size of each input's share in the log odds of the table's bars."""
    mean, scale = (dict(zip(GIVEN.features, x, strict=True)) for x in (GIVEN.mean, GIVEN.scale))
    table = spark.createDataFrame([(i, f, w) for i, (f, w) in enumerate(GIVEN.coefficients(), 1)], "rank long, feature string, weight double")
    rows = given(spark, sf).filter("probability_up IS NOT NULL")
    shares = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(w * (F.col(f) - mean[f]) / scale[f]).alias("share")) for f, w in GIVEN.coefficients()])).alias("s")).select("s.*")
    return rounded(table.join(shares.groupBy("feature").agg(F.avg("share").alias("mean_effect")), "feature").select("rank", "feature", "weight", "mean_effect"))


AS_OF = ("2024-01-01 05:00:05", "2024-01-01 08:20:40", "2024-01-01 08:21:04", "2024-01-01 08:30:09", "2023-12-31 23:00:00")


def _latest_sql(as_of: str) -> str:
    return f"""SELECT TIMESTAMP '{as_of}' AS decision_ts, la.ts AS source_ts, la.p, la.delay, po.payout FROM (SELECT 1) one LEFT JOIN (
  SELECT ts, p, epoch(TIMESTAMP '{as_of}') - epoch(ts) - 60 AS delay FROM kp WHERE ts + INTERVAL 1 MINUTE <= TIMESTAMP '{as_of}' ORDER BY ts DESC LIMIT 1) la ON true
  LEFT JOIN pa po ON po.seen_at <= la.ts + INTERVAL 1 MINUTE AND po.seen_at >= la.ts - INTERVAL 1 MINUTE"""


@query("latest_bar_decisions", f"""WITH RECURSIVE {SCORED_SQL}, pa AS MATERIALIZED (SELECT ts + INTERVAL 50 SECOND AS seen_at, 0.7::DOUBLE + (bar_idx % 20) / 100.0::DOUBLE AS payout FROM kp WHERE bar_idx % 4 = 0
), al AS ({' UNION ALL '.join(f'({_latest_sql(x)})' for x in AS_OF)}), re AS (SELECT *, CASE WHEN source_ts IS NULL THEN 'no_completed_candle' WHEN delay > 15 THEN 'completed_candle_is_stale' WHEN p IS NULL THEN 'insufficient_causal_feature_history'
  WHEN p < 0.501 AND p > 0.499 THEN 'frozen_probability_threshold_not_cleared' WHEN payout IS NULL THEN 'frozen_signal_without_fresh_payout' ELSE 'frozen_signal_with_fresh_payout' END AS reason FROM al)
SELECT decision_ts, source_ts, reason, CASE WHEN reason NOT LIKE 'frozen_signal%' THEN 'no_trade' WHEN p >= 0.501 THEN 'call' ELSE 'put' END AS direction, round(delay, 6)::DOUBLE AS delay_seconds,
  round(p, 6) AS probability_up, CASE WHEN reason LIKE 'frozen_signal%' THEN round(payout, 6) END AS payout FROM re""")
def latest_bar_decisions(spark, sf):
    """Decisions at five times: on the last candle complete by then, with the payout seen last before its end."""
    candles = context.add_ml_features(dense(spark, sf)).select(F.lit("ALL").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), *PRICES, *GIVEN.features)
    candles = written(candles, "candles")
    seen = dense(spark, sf).filter("bar_idx % 4 = 0").select(F.lit("ALL").alias("asset"), (F.col("ts") + F.expr("INTERVAL 50 SECONDS")).cast("timestamp").alias("observed_at"), (0.7 + (F.col("bar_idx") % 20) / 100.0).alias("payout"))
    out = None
    for at in AS_OF:
        made = models.score_latest(GIVEN, candles, seen, at, threshold=0.501, features=list(GIVEN.features))
        made = made.select("decision_ts", "source_ts", "reason", "direction", "delay_seconds", "probability_up", "payout")
        out = made if out is None else out.unionByName(made)
    return rounded(out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("decision_ts", "source_ts")}))


@query("logistic_out_of_fold")
def logistic_out_of_fold(spark, sf):
    """All inputs, five folds, as the protocol has it."""
    scored = models.oof_probabilities(models.prepare(dense(spark, sf), 3), "logistic", 5, 3)
    return rounded(scored.select("ts", "eligible", "target_up", "probability_up"))


@query("probability_thresholds")
def probability_thresholds(spark, sf):
    scored = models.oof_probabilities(models.prepare(dense(spark, sf), 3), "logistic", 5, 3)
    return rounded(models.threshold_scores(scored, Settlement(3), min_trades=5))


@query("boosted_trees")
def boosted_trees(spark, sf):
    """All inputs and rounds of the protocol: learned on the development slice, scored on the rest."""
    rows = models.prepare(search.split_slices(dense(spark, sf)), models.FROZEN_EXPIRY).withColumn("part", F.col("slice"))
    rows = written(rows, "boosted_trees")
    model = models.fit_boosted(rows.filter("part = 'development'"))
    return rounded(model.transform(rows.filter("part <> 'development'")).select("ts", "probability_up"))


_EDGE = "list_extract(v, 1 + CAST({}((n - 1) * (k * (100.0::DOUBLE / 255) / 100)) AS INT))"


@query("boosted_first_split", f"""WITH RECURSIVE {inputs_sql()}, y0 AS (
  SELECT *, CASE WHEN lead(close, 3) OVER o > lead(open, 1) OVER o THEN 1 WHEN lead(close, 3) OVER o < lead(open, 1) OVER o THEN 0 END AS y FROM x
  WHERE bar_idx < (SELECT floor(count(*) * 0.6::DOUBLE) FROM x) WINDOW o AS (ORDER BY ts)
), tr AS (SELECT * FROM y0 WHERE y IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in context.ML_FEATURES)}), p AS (
  SELECT avg(y) AS p FROM tr
), u AS MATERIALIZED ({' UNION ALL '.join(f"SELECT {i} AS f, '{name}' AS feature, {name}::DOUBLE AS v, round((p - y) * 1073741824) / 1073741824 AS g, round(p * (1 - p) * 1073741824) / 1073741824 AS h FROM tr, p" for i, name in enumerate(context.ML_FEATURES))}
), l AS (SELECT f, feature, list(v ORDER BY v) AS v, list_sort(list_distinct(list(v))) AS d, count(*) AS n, sum(g) AS g, sum(h) AS h FROM u GROUP BY ALL), e AS (
  SELECT f, feature, n, g, h, unnest(CASE WHEN len(d) <= 255 THEN list_transform(range(1, len(d)), lambda k: (d[k] + d[k + 1]) * 0.5)
    ELSE list_distinct(list_transform(range(1, 255), lambda k: ({_EDGE.format('floor')} + {_EDGE.format('ceil')}) * 0.5)) END) AS edge FROM l
), s AS (
  SELECT e.f, e.feature, edge, e.n, e.g, e.h, sum(u.g) FILTER (WHERE v <= edge) AS lg, sum(u.h) FILTER (WHERE v <= edge) AS lh, count(*) FILTER (WHERE v <= edge) AS ln FROM e JOIN u USING (f) GROUP BY ALL
), c AS (SELECT *, lg * lg / (lh + 1) + (g - lg) * (g - lg) / (h - lh + 1) - g * g / (h + 1) AS gain FROM s WHERE ln >= 100 AND n - ln >= 100)
SELECT feature, round(edge, 6) AS threshold, round(-0.05 * lg / (lh + 1), 6) AS left_value, round(-0.05 * (g - lg) / (h - lh + 1), 6) AS right_value FROM c WHERE gain > 0
ORDER BY round(gain, 9) DESC, f, edge LIMIT 1""")
def boosted_first_split(spark, sf):
    """The first split of boosted trees on the development slice, and its leaves."""
    rows = models.prepare(search.split_slices(dense(spark, sf)), models.FROZEN_EXPIRY).filter("slice = 'development' AND eligible AND target_up IS NOT NULL")
    (_, _, feature, threshold, *_), *leaves = boosting.fit_trees(rows, context.ML_FEATURES, boosting.Settings(rounds=1, leaves=2)).table()
    found = [(feature, round(threshold, 6), *(round(x[-1], 6) for x in leaves))] if leaves else []
    return spark.createDataFrame(found, "feature string, threshold double, left_value double, right_value double")


@contextmanager
def in_blocks(spark, **sizes):
    """Recursions planned while it lasts run over blocks of their series."""
    for name, size in sizes.items():
        spark.conf.set(f"tidemark.blocks.{name}", str(size))
    try:
        yield
    finally:
        for name in sizes:
            spark.conf.unset(f"tidemark.blocks.{name}")


@query("core_features_in_blocks", ORACLE_SQL["core_features"])
def core_features_in_blocks(spark, sf):
    """The core features with the one series in blocks of three days, each a task's own."""
    with in_blocks(spark, days=3):
        return QUERIES["core_features"](spark, sf)


@query("settlement_no_overlap_in_blocks", ORACLE_SQL["settlement_no_overlap_cooldown_2"])
def settlement_no_overlap_in_blocks(spark, sf):
    """Trades one after the other, by blocks of 50 bars."""
    with in_blocks(spark, bars=50):
        return QUERIES["settlement_no_overlap_cooldown_2"](spark, sf)
