"""Slices, parameter search, gates and walk-forward runs."""

from __future__ import annotations

import itertools
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.signals import Family
from tidemark.operators.bars import series, contiguous_ahead, numbered, with_breaks
from tidemark.operators.metrics import counts, metrics, score
from tidemark.operators.settle import Settlement, outcome, profit, settle, settle_all
from tidemark.session import written


SHARES = (0.6, 0.2)


def split_slices(bars: DataFrame, development: float = SHARES[0], validation: float = SHARES[1]) -> DataFrame:
    """Set `slice` by position in the series: development, validation, and the rest locked. Renumbers the bars."""
    if min(development, validation) <= 0 or development + validation >= 1:
        raise ValueError("shares must be positive and leave a rest")
    w = Window.partitionBy("series_id")
    rows = bars.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy("ts")) - 1})
    first, second = F.floor(F.col("_n") * development), F.floor(F.col("_n") * development) + F.floor(F.col("_n") * validation)
    few = F.when(F.col("_n") < 3, F.raise_error(F.lit("a split needs at least 3 rows")).cast("string"))
    name = few.when(F.col("_i") < first, "development").when(F.col("_i") < second, "validation").otherwise("locked")
    return numbered(rows.withColumn("slice", name).drop("_n", "_i"))


def parameter_sets(grid) -> list[dict]:
    """The product of a grid in order: the first key varies slowest."""
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def parameter_table(spark, grid) -> DataFrame:
    """candidate, params (JSON) and a column p_<name> for each parameter."""
    sets = parameter_sets(grid)
    kinds = {bool: "boolean", int: "int", float: "double"}
    fields = ", ".join(f"p_{k} {kinds[type(v[0])]}" for k, v in grid.items())
    rows = [(i, json.dumps(s, sort_keys=True), *s.values()) for i, s in enumerate(sets)]
    return spark.createDataFrame(rows, f"candidate int, params string, {fields}")


@dataclass(frozen=True)
class Variant:
    expiry_bars: int
    entry_offset_bars: int = 1
    payout: float = 0.82
    min_payout: float | None = None


def with_outcomes(bars: DataFrame, variants: list[Variant], payout_column: str | None = None) -> DataFrame:
    """Add `settled`: per variant the prices and payout of a trade signalled at this bar, where its horizon is whole."""
    rows = with_breaks(bars)
    items = []
    for i, v in enumerate(variants):
        off, out = v.entry_offset_bars, v.entry_offset_bars + v.expiry_bars - 1
        payout = F.lead(payout_column, off).over(series()).cast("double") if payout_column else F.lit(float(v.payout))
        ok = contiguous_ahead(out) & (F.lit(True) if v.min_payout is None else payout >= v.min_payout)
        cell = F.struct(F.lit(i).alias("variant"), F.lead("open", off).over(series()).alias("entry"), F.lead("close", out).over(series()).alias("exit"), payout.alias("payout"))
        items.append(F.when(ok, cell))
    return rows.withColumn("settled", F.filter(F.array(*items), lambda x: x.isNotNull())).drop("breaks")


def grid_search_matrix(features: DataFrame, family: Family, variants: list[Variant], objective: str = "wilson_low", min_trades: int = 30,
                       min_expectancy: float | None = None, payout_column: str | None = None) -> DataFrame:
    """Order-free metrics and rank of every (candidate, variant): candidate, params, variant, trades, ..., score, position.

    The grid is a fixed table of at most some hundred rows, so the join with it by the rule is
    broadcast and yields signals only; each is then settled for all variants from one array.
    Drawdown and streaks do not enter a score; evaluate() adds them for the chosen.
    """
    spark = features.sparkSession
    params = parameter_table(spark, family.grid)
    rule = family.rule({k: F.col(f"p_{k}") for k in family.grid})
    ready = with_outcomes(features, variants, payout_column)
    hits = ready.crossJoin(F.broadcast(params)).withColumn("direction", rule).filter("direction <> 0")
    trades = hits.select("candidate", "direction", F.explode("settled").alias("s")).select("candidate", "direction", "s.*")
    trades = trades.withColumn("result", outcome(F.col("direction"), F.col("entry"), F.col("exit")))
    trades = trades.withColumn("pnl", profit(F.col("result"), F.col("payout")))
    every = params.select("candidate", "params").crossJoin(spark.range(len(variants)).select(F.col("id").cast("int").alias("variant")))
    found = every.join(counts(trades, ["candidate", "variant"]), ["candidate", "variant"], "left").fillna(0, ["trades", "wins", "losses", "ties", "total_pnl"])
    found = found.withColumn("score", score(objective, min_trades, min_expectancy))
    order = Window.orderBy(F.col("score").desc_nulls_last(), "candidate", "variant")  # one row a candidate and variant
    return found.withColumn("position", F.row_number().over(order))


def evaluate(features: DataFrame, rule: Column, cfg: Settlement) -> DataFrame:
    return metrics(settle(features.withColumn("signal", rule), "signal", cfg))


@dataclass(frozen=True)
class Gate:
    min_trades: int = 30
    min_expectancy: float = 0.0
    min_wilson_low: float = 0.5

    def passes(self, m: dict) -> bool:
        return m["trades"] >= self.min_trades and (m["expectancy"] or 0) > self.min_expectancy and (m["wilson_low"] or 0) > self.min_wilson_low


def evidence_gate(min_resolved: int, payout: float) -> Column:
    """Enough resolved trades, a positive expectancy, and a lower bound above break-even."""
    return F.coalesce((F.col("wins") + F.col("losses") >= min_resolved) & (F.col("expectancy") > 0) & (F.col("wilson_low") > 1 / (1 + payout)), F.lit(False))


def run_experiment(bars: DataFrame, family: Family, variants: list[Variant], gate: Gate = Gate(), objective: str = "wilson_low",
                   min_trades: int = 30, min_locked: int = 30, min_expectancy: float | None = None,
                   payout_column: str | None = None) -> dict:
    """Search on development, gate on validation, and only then open the locked slice.

    Each slice is an action of its own: rows of the locked slice are not read unless the gate passed.
    """
    parts = written(split_slices(bars), "slices")
    of = lambda name: family.prepared(parts.filter(F.col("slice") == name))
    ranked = grid_search_matrix(of("development"), family, variants, objective, min_trades, min_expectancy, payout_column)
    best = ranked.filter("score IS NOT NULL").orderBy("position").limit(1).collect()
    if not best:
        return {"status": "no_development_candidate"}
    chosen = best[0].asDict()
    v = variants[chosen["variant"]]
    cfg = Settlement(v.expiry_bars, v.entry_offset_bars, v.payout, payout_column, v.min_payout)
    rule = family.rule(json.loads(chosen["params"]))
    out = {"family": family.name, "params": json.loads(chosen["params"]), "variant": asdict(v), "development": chosen}
    out["validation"] = evaluate(of("validation"), rule, cfg).first().asDict()
    if not gate.passes(out["validation"]):
        return out | {"status": "rejected_validation"}
    out["locked"] = evaluate(of("locked"), rule, cfg).first().asDict()
    return out | {"status": "tested" if out["locked"]["trades"] >= min_locked else "insufficient_locked_test"}


def walk_forward_windows(bars: DataFrame, train: int, test: int, step: int | None = None) -> DataFrame:
    """Bars copied into each window that holds them: window_id, role train or test; slices become the windows' parts.

    A bar lies in a bounded number of windows, found by arithmetic, so there is no join.
    """
    step = step or test
    if min(train, test, step) < 1:
        raise ValueError("train, test and step must be >= 1")
    w = Window.partitionBy("series_id")
    rows = bars.withColumns({"_i": F.row_number().over(w.orderBy("ts")) - 1, "_n": F.count(F.lit(1)).over(w)})
    last = F.floor((F.col("_n") - (train + test)) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (train + test) + 1) / F.lit(step)))
    upto = F.least(last, F.floor(F.col("_i") / F.lit(step)))
    rows = rows.filter(first <= upto).withColumn("window_id", F.explode(F.sequence(first.cast("int"), upto.cast("int"))))
    role = F.when(F.col("_i") - F.col("window_id") * step < train, "train").otherwise("test")
    rows = rows.withColumn("role", role).withColumn("slice", F.concat_ws("/", F.col("window_id").cast("string"), "role"))
    return numbered(rows.drop("_i", "_n"))


def walk_forward(bars: DataFrame, family: Family, variant: Variant, train: int, test: int, step: int | None = None,
                 objective: str = "expectancy", min_trades: int = 20) -> DataFrame:
    """Per window the candidate that is best in training, and its test metrics; windows without a viable one are left out."""
    spark = bars.sparkSession
    features = family.prepared(walk_forward_windows(bars, train, test, step))
    params = parameter_table(spark, family.grid)
    rule = family.rule({k: F.col(f"p_{k}") for k in family.grid})
    ready = with_outcomes(features, [variant])
    hits = ready.crossJoin(F.broadcast(params)).withColumn("direction", rule).filter("direction <> 0")
    trades = hits.select("series_id", "window_id", "role", "candidate", "params", "direction", F.explode("settled").alias("s")).select("*", "s.*")
    trades = trades.withColumn("result", outcome(F.col("direction"), F.col("entry"), F.col("exit")))
    trades = trades.withColumn("pnl", profit(F.col("result"), F.col("payout")))
    by = ["series_id", "window_id", "candidate", "params"]
    trained = counts(trades.filter("role = 'train'"), by).withColumn("score", score(objective, min_trades)).filter("score IS NOT NULL")
    first = Window.partitionBy("series_id", "window_id").orderBy(F.desc("score"), "candidate")
    best = trained.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*by, F.col("score").alias("train_score"), F.col("trades").alias("train_trades"))
    tested = counts(trades.filter("role = 'test'"), by).select(*by, "trades", "wins", "losses", "ties", "expectancy", "win_rate", "wilson_low")
    return best.join(tested, by, "left").fillna(0, ["trades", "wins", "losses", "ties"])


def benchmark_strategies(bars: DataFrame, strategies: dict, cfg: Settlement = Settlement()) -> DataFrame:
    """Metrics of named rules on each slice: strategy, slice, trades, ... All signals are settled in one pass."""
    rows, names = split_slices(bars), list(strategies)
    for i, name in enumerate(names):
        rows = strategies[name](rows).withColumnRenamed("signal", f"signal_{i}")
    trades = settle_all(rows, [(f"signal_{i}", cfg) for i in range(len(names))])
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("plan") + 1)
    return metrics(trades.withColumn("strategy", named), ["strategy", "slice"])
