"""Reports: baselines and gated family experiments of a candle table, as one nested dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.signals import FAMILIES, STRATEGIES
from tidemark.operators.metrics import metrics
from tidemark.operators.settle import Settlement, settle
from tidemark.operators.validate import diagnose, fingerprint
from tidemark.plans.search import Gate, Variant, run_experiment, split_slices


@dataclass(frozen=True)
class BenchmarkPolicy:
    families: tuple[str, ...] = ("trend_pullback", "range_reversion", "breakout")
    expiries: tuple[int, ...] = (1, 2, 3, 5)
    payout: float = 0.82
    min_trades: int = 30
    min_expectancy: float | None = 0.0


def payload(m: dict) -> dict:
    """A metrics row with None for what is not defined; plain values that JSON holds."""
    return {k: None if isinstance(v, float) and v != v else v for k, v in m.items()}


def baselines(bars: DataFrame, expiries, payout: float, names=("always_call", "always_put", "random")) -> list[dict]:
    """Each simple rule at each expiry, on the development slice."""
    dev = split_slices(bars).filter(F.col("slice") == "development")
    out = []
    for name in names:
        for e in expiries:
            row = metrics(settle(STRATEGIES[name](dev), "signal", Settlement(e, payout=payout))).first().asDict()
            out.append({"strategy": name, "expiry_bars": e} | payload(row))
    return out


def public_benchmark(bars: DataFrame, source: str, policy: BenchmarkPolicy = BenchmarkPolicy()) -> dict:
    variants = [Variant(e, payout=policy.payout) for e in policy.expiries]
    gate = Gate(policy.min_trades, 0.0, 1 / (1 + policy.payout))
    diagnostics = diagnose(bars).first().asDict()
    return {
        "source": source, "fingerprint": fingerprint(bars.select("ts", "open", "high", "low", "close")).first()["fingerprint"],
        "diagnostics": {k: str(v) if k.endswith("_ts") else v for k, v in diagnostics.items()},
        "baselines": baselines(bars, policy.expiries, policy.payout),
        "evaluations": sum(FAMILIES[f].size for f in policy.families) * len(variants),
        "families": {f: run_experiment(bars, FAMILIES[f], variants, gate, min_trades=policy.min_trades, min_expectancy=policy.min_expectancy) for f in policy.families},
    }
